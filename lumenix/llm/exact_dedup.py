"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each text, stripped of white space, is cut where its content says so (a boundary of three characters, 515 to
4,096 characters apart), so equal texts have equal cuts. A chunk's identifier is a pair of 64-bit hashes, and
it is verified: one shuffle moves every distinct chunk beside those with the same identifier, and the hash
family is only accepted once no identifier stands for two contents (else the next seed is tried). From then
on ordered identifier lists stand for the texts, and texts are not moved again.

Edge cases: null counts as empty; all texts without other characters are equal (an empty list); ties in length
go to the smaller id, a null id comes after any other; repeated rows are members like any others and all rows
of the id that stays are ``kept`` (``keep_first`` returns one of them); only ``doc_id`` and ``text`` are read, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenix.llm import common, groups

BLANK = r"[\x20\x09-\x0D]+"
MAX_SEEDS = 16


# Three classes of characters, each with a share of the frequent ones of several scripts. A text without any of them is
# cut at the largest size. Few ranges: the engine tries a class's ranges one by one, at every character.
BOUNDARY = (
    "[hlHL17\u00e0-\u00e4\u03b1-\u03b3\u0430-\u0433\u0627-\u0629\u3042-\u304b\u4e00-\u53ff]"
    "[eoEO28\u00e8-\u00ea\u03b5-\u03b9\u0435-\u0438\u0644-\u0646\u3057-\u3060\u5400-\u65ff]"
    "[rnRN39\u00f1-\u00f6\u03bd-\u03c1\u043d-\u0440\u0631-\u0633\u306a-\u3078\u6600-\u77ff]"
)
CHUNK = f"(?s).{{512,4093}}?{BOUNDARY}|.{{1,4096}}"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def chunks(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk)]


def injective(documents: DataFrame, seed: int) -> bool:
    """Whether under ``seed`` no two different chunks of the table share an identifier; each distinct chunk moves once."""
    a, b = identifier(F.col("chunk"), seed)
    distinct = documents.select(F.explode(chunks(normalized(F.col("text")))).alias("chunk")).select(a.alias("a"), b.alias("b"), "chunk").distinct()
    return distinct.groupBy("a", "b").count().where("count > 1").limit(1).count() == 0


def recipes(documents: DataFrame, seed: int) -> DataFrame:
    """Per document: its id, code points, digest of the stripped text, and ordered chunk identifiers."""
    base = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalized(F.col("text")).alias("normal"))
    return base.select(
        "doc_id",
        "n_points",
        F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"),
        F.flatten(F.transform(chunks(F.col("normal")), lambda c: F.array(*identifier(c, seed)))).alias("recipe"),
    )


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    for seed in range(MAX_SEEDS):
        if injective(documents, seed):
            break
    else:
        raise RuntimeError("no hash family tells all chunks apart")
    rows = common.materialize(recipes(documents, seed), "recipes")
    # Longest first, then smallest id: the least of (-points, id is null, id).
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("keep_id"))).alias("best")
    joined = groups.attach(rows, ["recipe"], [best], row_salt=["doc_id", "n_points"])
    keep = F.col("best.keep_id")
    return joined.select("doc_id", keep.alias("keep_id"), F.col("group_rows").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that stay, all columns; of repeated rows (equal id and text) one. A column may have any name."""
    name = common.unused_name(documents, "kept_doc_id")
    kept = dedup(documents).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return common.one_of_each(documents.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi"), documents, normalized(F.col("text")))
