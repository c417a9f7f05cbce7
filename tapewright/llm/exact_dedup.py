"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks of the corpus are sorted and
numbered; then adjacent names are paired, the distinct pairs sorted and numbered in turn, until one name is left for each
document. Documents with as many blocks and the same last name are equal, byte for byte: no step relies on a hash.

A 64-bit hash of a block is only the key by which a block finds its name. Hashes that two different blocks share are found
in the name table, and those blocks are joined by their bytes instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import ascii_lower, packed, plain_text
from tapewright.session import stage

NO_PARTNER = -1  # stands for the missing right half of an odd last pair; names are 0 and up, or -2 and down


def _numbered(distinct: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Sort the rows of each partition and number them without collisions; staged, so that the numbers stay."""
    return stage(distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "block-names")


def document_names(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_sha256, n_blocks and name.

    Two rows have the same (n_blocks, name) if and only if their texts are the same after lower-casing A-Z; null counts as
    empty. ``hash_bits`` below 64 makes blocks share hashes on purpose, for tests. The row ids are new and unique, so
    repeated or null document ids do no harm.
    """
    text = ascii_lower(plain_text(text_col))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("b", F.col("t").cast("binary"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / F.lit(block_bytes)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("b", i * F.lit(block_bytes) + 1, F.lit(block_bytes)))
    key = lambda block: F.shiftrightunsigned(F.xxhash64(block), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(block)

    rows = stage(
        src.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("b", 256).alias("text_sha256"), F.transform(blocks, key).alias("keys")),
        "block-rows",
    )
    cut = src.select(F.explode(blocks).alias("block")).select(key(F.col("block")).alias("key"), "block")
    # Grouped by the bytes themselves; copies meet in the map tasks already.
    named = stage(
        cut.groupBy("key", "block").agg(F.lit(1).alias("one")).sortWithinPartitions("block").select("key", F.monotonically_increasing_id().alias("name")), "block-names"
    )
    shared = named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")

    placed = rows.select("row_id", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key"))
    if shared.isEmpty():
        level = placed.join(named, "key").drop("key")
    else:
        shared = stage(shared, "block-shared")
        by_bytes = _numbered(cut.join(shared, "key", "left_semi").groupBy("block").agg(F.lit(1).alias("one")).select("block"), ["block"])
        by_bytes = by_bytes.select("block", (F.lit(NO_PARTNER - 1) - F.col("name")).alias("name"))
        # The rows again, with their bytes, for these few keys. Row ids come from ``rows``: the text digest and the keys
        # lead back to them, and rows that agree in both have the same texts.
        texts = src.select(F.sha2("b", 256).alias("text_sha256"), F.posexplode(blocks).alias("pos", "block")).withColumn("key", key(F.col("block")))
        texts = texts.join(shared, "key", "left_semi").groupBy("text_sha256", "pos", "block").agg(F.lit(1).alias("one")).join(by_bytes, "block")
        hit = rows.select("row_id", "text_sha256", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key")).join(shared, "key", "left_semi")
        level = (
            placed.join(shared, "key", "left_anti").join(named, "key").select("row_id", "n_blocks", "pos", "name")
            .unionByName(hit.join(texts.select("text_sha256", "pos", "name"), ["text_sha256", "pos"]).select("row_id", "n_blocks", "pos", "name"))
        )

    level = stage(level.select("row_id", "n_blocks", "pos", "name"), "block-level")
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    done = level.filter("n_blocks = 1")
    width = 1
    while width < longest:
        halves = level.filter(F.col("n_blocks") > width).groupBy("row_id", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
        pairs = halves.agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(NO_PARTNER)).alias("b"))
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        level = stage(pairs.join(names, ["a", "b"]).select("row_id", "n_blocks", "pos", "name"), "block-level")
        width *= 2
        done = done.unionByName(level.filter((F.col("n_blocks") <= width)))
    return rows.drop("keys").join(done.drop("pos"), "row_id")


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, row_id; one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with the largest
    document id stays; of rows that share that id, the first. A null id is smaller than any other, so ``keep_id`` is null
    only where all ids of the group are. An empty table gives no rows; other columns are not read.
    """
    named = stage(document_names(docs, **options), "block-documents")
    # Sizes and survivors are summed in the map tasks, then joined back: no window over a group of copies.
    best = named.groupBy("n_blocks", "name").agg(
        F.max(F.struct(F.col("doc_id"), (-F.col("row_id")).alias("order"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return named.join(best, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.order") == -F.col("row_id")).alias("kept"), "text_sha256", "row_id"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of rows that repeat both id and text one stays, the first by its columns written as JSON. Null texts count as empty, and a null
    id is an id like another. An empty table gives no rows.
    """
    marked = stage(exact_duplicates(docs, id_col=id_col, text_col=text_col), "block-kept")
    kept = marked.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = packed(docs, id=F.col(id_col), sha=F.sha2(ascii_lower(plain_text(text_col)).cast("binary"), 256))
    if not marked.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = rows.groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi").select("row.*")
