"""SimHash near-duplicate detection by a segment-popcount embedding.

Fingerprint: 64 bits; a bit is set where over half of the text's shingle
hashes (XXH64, seed 42) have it set. Links: fingerprints at ``max_bits`` (2)
differing bits or fewer.

Candidates: a fingerprint is cut into 32 segments of 2 bits, and its embedding
is the vector of the segments' bit counts, packed two bits each into one long.
Two fingerprints differ in at least as many bits as the Manhattan distance of
their embeddings, so only embeddings within distance 2 can link. On the
integer grid two such points have a common point at distance 1 or less from
both: every fingerprint is dealt to its own cell and to the valid cells one
step away (49 on average), and an equi-join on the cell is the range join. The
join's condition verifies the real bit distance. Random fingerprints pass the
Manhattan bound with a probability of about 2e-11, so candidates stay near the
number of links; only distinct fingerprints are joined, never the documents of
a group.

Components: links between distinct fingerprints are contracted by large-star /
small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import materialize, unused, utf8_chunks

SEED = 42
LOW_BITS = 0x5555555555555555  # the low bit of each of the 32 segments


def _text_fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D separate
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(g), SEED) for g in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[i:i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash of a text column as a long; null and empty texts give 0."""
    @F.arrow_udf("long")
    def simhash(col: pa.Array) -> pa.Array:
        out = []
        for data, offs in utf8_chunks(col):
            raw = data.tobytes()
            out += [_text_fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return pa.array(out, pa.int64())
    return simhash(text)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in the segment's two bits.
    (Bitwise only: sums could overflow the signed long.)"""
    low = fp.bitwiseAND(F.lit(LOW_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid(fps: DataFrame) -> DataFrame:
    """``(fp, cell)``: the embedding and every valid embedding one step away.

    A count goes 0-1 by flipping its low bit and 1-2 by flipping both, so step
    2i of segment i flips 01 if the count is below 2, step 2i+1 flips 11 if it
    is above 0; step 64 stays.
    """
    steps = fps.select("fp", embedding(F.col("fp")).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(64))).alias("step"))
    count = F.expr("shiftrightunsigned(e, step - step % 2) & 3")
    valid = (F.col("step") == 64) | F.when(F.col("step") % 2 == 0, count < 2).otherwise(count > 0)
    cell = F.expr("if(step = 64, e, e ^ shiftleft(if(step % 2 = 0, 1L, 3L), step - step % 2))")
    return steps.where(valid).select("fp", cell.alias("cell"))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of distinct fingerprints (column ``fp``) that link."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid of one step on each side is exact up to 2 bits")
    dealt = grid(fps)
    u = dealt.select("cell", F.col("fp").alias("u"))
    v = dealt.select("cell", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    # some 49 cells a fingerprint, but Spark takes the explode's output for one row each, so it would broadcast it
    return u.join(v.hint("merge"), "cell").where(near).select("u", "v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_forest(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components: ``(v, u)`` for each vertex v that isn't the smallest,
    u, of its component. Minima are aggregates joined back, so a hub's neighbours
    are never gathered in one group."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "links")
    before = _mark(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u"))
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(down, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(joined.select("v", F.col("m").alias("u")))
        edges = materialize(small.where("u < v").distinct(), "links")
        now = _mark(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, root)`` for every distinct value of column ``fp``; root is the
    smallest fingerprint that links reach."""
    distinct = materialize(prints.select("fp").distinct(), "fingerprints")
    forest = star_forest(links(distinct, max_bits))
    return (distinct.join(forest.withColumnsRenamed({"v": "fp", "u": "root"}), "fp", "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that chains of links reach.

    Null and empty texts have fingerprint zero and link like any other; texts of
    fewer words than a shingle are one shingle; words repeat, ties (half of the
    hashes) leave a bit 0. Repeated rows give repeated rows. A null id is never
    the smallest; a component with null ids only has a null ``component_id``. An
    empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    roots = materialize(components(prints, max_bits), "components")
    # ids are reduced per fingerprint before roots are met: a hot group is one row
    low = prints.groupBy("fp").agg(F.min("id").alias("low")).join(roots, "fp")
    first = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(roots.join(first, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the
    smallest id (null ids last, any one of repeated rows).

    Rows are numbered once, in a written table of the texts with their numbers
    and fingerprints that both the grouping and the final join read: numbers of
    a second read could name other rows."""
    row, fp = unused(docs, "row_number", "fp")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, fingerprint(F.col(text_col), shingle)), "simhash")
    prints = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    roots = components(prints, max_bits)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(roots, "fp")
    kept = best.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(materialize(kept, "kept").hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
