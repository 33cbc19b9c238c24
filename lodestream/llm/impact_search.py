"""Ranked lexical search over a bit-sliced impact index.

``build_index`` cuts the documents into segments (``SEGMENT_DOCS`` documents or
``SEGMENT_BYTES`` of text) and writes one row per segment and term, for every term of
every document: which documents of the segment hold it, and a bitmap over these for each
of the ``SLICES`` bits of their impact, (10^9 tf) div (1000 tf + 12 m). A segment is made by one
task, so the index is built without a shuffle. An impact does not depend on how rare the
term is; that weight is multiplied in at search time, so it comes from the index itself.

``search`` joins the index with the terms that the items ask for and brings these together by
segment and block of items. There all arithmetic is on bitmaps: a term's slices times its
weight are the slices added at the places of the weight's bits, an item's scores are the sum
of its terms' slices, both by full adders that carry from slice to slice; and the k best are
found from the most significant slice down: documents that have the bit go ahead of those
that lack it, until k are left. Documents are numbered by id inside a segment, so of equal
scores at the last place the lower ids stay. Only k documents a segment and item are then
ranked over all segments.

Terms are told apart by 64-bit hashes. Defined results: null and empty texts have no terms
and are found by nothing; items without terms, or with terms that no document has, have no
rows. Rows that repeat are documents (or items) of their own, also where ids repeat; a
document with a null id comes last among equal scores. Very long texts are read in full, a
segment may be one document. Empty tables give no rows. Columns besides the id and the
text are not read.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Scratch, checkpoint
from lodestream.llm.words_np import LOWER, blocks, row_ranges, run_hashes, runs

SEGMENT_DOCS, SEGMENT_BYTES = 4096, 16 << 20
#: Impacts are below 10^6.
SLICES = 20
#: Items that are searched for together, and terms whose bitmaps are multiplied together.
BLOCK_ITEMS, BLOCK_TERMS = 256, 256
#: Pairs of an item and a term (16 bytes each) up to which these are broadcast to the index.
BROADCAST_PAIRS = 1 << 19

#: Bytes of the characters that terms consist of, [0-9A-Za-z] and all above U+007F.
IS_TERM = np.ones(256, bool)
IS_TERM[:0x30] = IS_TERM[0x3A:0x41] = IS_TERM[0x5B:0x61] = IS_TERM[0x7B:0x80] = False

INDEX = "segment long, term long, docs int, places binary, slices binary"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and where each text's begin (and the end)."""
    data = LOWER[data]
    starts, ends = runs(IS_TERM[data], offsets)
    return run_hashes(data, starts, ends), row_ranges(starts, offsets)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose values end at ``ends`` of the bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1, offset=4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _segment(number: int, ids: list, hashes: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Index rows of one segment; the first, without a term, has the ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(hashes[i]) for i in order], np.int64)
    words = np.concatenate([np.empty(0, np.uint64), *[hashes[i] for i in order]])
    docs = np.repeat(np.arange(len(order)), lengths)
    by = np.argsort(words, kind="stable")  # keeps the order of the documents inside a term
    words, docs = words[by], docs[by]
    new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (docs[1:] != docs[:-1])))) if len(words) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(words)))
    words, docs = words[new], docs[new]  # one of each term and document
    m = {n: 75 + 25 * n * n_docs // n_terms for n in np.unique(lengths).tolist() if n}  # Python's integers cannot overflow
    m = np.array([m.get(n, 0) for n in lengths.tolist()], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(words)))
    octets = (count + 7) // 8  # each term's documents fill whole bytes of a slice
    start = np.cumsum(octets) - octets
    at = np.repeat(8 * start - first, count) + np.arange(len(words))
    bits = np.zeros((8 * int(octets.sum()), SLICES), bool)
    bits[at] = (impact[:, None] >> np.arange(SLICES)) & 1
    slices = np.packbits(bits, axis=0, bitorder="little")
    known = np.array([ids[i] is not None for i in order], np.uint8)
    own = np.concatenate((np.array([ids[i] or 0 for i in order], "<i8").view(np.uint8), known))
    terms = pa.array(np.concatenate(([0], words[first].view(np.int64))), mask=np.arange(len(first) + 1) == 0)
    places = np.concatenate((own, docs.astype("<u2").view(np.uint8)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, number)),
            terms,
            pa.array(np.concatenate(([len(order)], count)).astype(np.int32)),
            _binary(places, np.concatenate(([len(own)], len(own) + 2 * np.cumsum(count)))),
            _binary(slices.reshape(-1), np.concatenate(([0], SLICES * np.cumsum(octets)))),
        ],
        ["segment", "term", "docs", "places", "slices"],
    )


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all documents have, with repeats."""

    def count(batches):
        for batch in batches:
            n = total = 0
            for _, _, data, offsets in blocks(batch.column(0)):
                starts, _ = runs(IS_TERM[data], offsets)
                each = np.diff(row_ranges(starts, offsets))
                n, total = n + int((each > 0).sum()), total + int(each.sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    row = docs.select(text_col).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index of all documents (one row a segment and term, and one without a term a segment), and N."""
    n_docs, n_terms = corpus_size(docs, text_col)

    def index(batches):
        number, ids, hashes, size = TaskContext.get().partitionId() << 31, [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, end, data, offsets in blocks(batch.column(1)):
                words, first = terms_of(data, offsets)
                for i in range(end - row):
                    if ids and (len(ids) == SEGMENT_DOCS or size + int(offsets[i + 1] - offsets[i]) > SEGMENT_BYTES):
                        yield _segment(number, ids, hashes, n_docs, n_terms)
                        number, ids, hashes, size = number + 1, [], [], 0
                    ids.append(names[row + i])
                    hashes.append(words[first[i] : first[i + 1]])
                    size += int(offsets[i + 1] - offsets[i])
        if ids:
            yield _segment(number, ids, hashes, n_docs, n_terms)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(index, INDEX), n_docs


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): each item (row) by a number of its own."""

    def split(batches):
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(2)):
                words, first = terms_of(data, offsets)
                rows = np.repeat(np.arange(row, end), np.diff(first))
                pairs, times = np.unique(np.stack((rows.astype(np.uint64), words), axis=1), axis=0, return_counts=True)
                at = pa.array(pairs[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(times)], ["item", "item_id", "term", "times"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col))
    return numbered.mapInArrow(split, "item long, item_id long, term long, times long")


def _add(total: np.ndarray, more: np.ndarray, at: int) -> None:
    """Add bit-sliced numbers at a place: full adders, then the carry as far as it goes. First axis: slices, least first."""
    carry = np.zeros_like(total[0])
    for s, b in enumerate(more, at):
        a = total[s]
        differ = a ^ b
        total[s], carry = differ ^ carry, (a & b) | (carry & differ)
    s = at + len(more)
    while carry.any():  # the sum fits, so the carry ends before the slices do
        total[s], carry = total[s] ^ carry, total[s] & carry
        s += 1


def _multiplied(slices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bit-sliced numbers (slices, terms, words) times one weight a term."""
    out = np.zeros((SLICES + max(1, int(weights.max()).bit_length()) + 1, *slices.shape[1:]), np.uint64)
    for bit in range(int(weights.max()).bit_length()):
        has = (weights >> bit) & 1 == 1
        if has.any():
            _add(out, np.where(has[:, None], slices, np.uint64(0)), bit)
    return out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bit-sliced scores (slices, items, words): item, document and score of each item's k best above 0; of equal scores the first documents."""
    ahead, even = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for s in range(len(total) - 1, -1, -1):
        have = ahead | (even & total[s])
        few = (np.bitwise_count(have).sum(axis=1) <= k)[:, None]
        ahead, even = np.where(few, have, ahead), np.where(few, even & ~total[s], even & total[s])
    left = k - np.bitwise_count(ahead).sum(axis=1).astype(np.int64)
    bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").astype(bool)
    equal = bits(even)
    items, docs = np.nonzero(bits(ahead) | (equal & (np.cumsum(equal, axis=1) <= left[:, None])))
    score = np.zeros(len(items), np.int64)
    for s in range(len(total)):
        score |= ((total[s][items, docs >> 6] >> (docs & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    return items, docs, score


def _expanded(count: np.ndarray, places: np.ndarray, slices: np.ndarray, n_words: int) -> np.ndarray:
    """Bitmaps over the segment's documents, (slices, terms, words), of terms whose bitmaps are over their own."""
    rows = np.repeat(np.arange(len(count)), count)
    octets = (count + 7) // 8
    own = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(8 * (np.cumsum(octets) - octets), count)
    bits = np.unpackbits(slices.reshape(-1, SLICES), axis=0, bitorder="little")[own]
    full = np.zeros((SLICES, len(count), 64 * n_words), bool)
    full[:, rows, places] = bits.T
    return np.packbits(full, axis=2, bitorder="little").view(np.uint64)


def _searched(rows: pa.Table, k: int) -> tuple[np.ndarray, ...] | None:
    """Of one segment and block of items: item, id, whether that is null, and score of each item's k best."""
    rows = rows.combine_chunks()
    own = rows.filter(pc.is_null(rows["term"]))
    rows = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
    if not own.num_rows or not rows.num_rows:
        return None
    n = own["docs"][0].as_py()
    raw = own["places"][0].as_buffer()
    ids, known = np.frombuffer(raw, "<i8", count=n), np.frombuffer(raw, np.uint8, count=n, offset=8 * n)
    uses = rows["uses"].chunk(0)
    flat = uses.flatten()
    of_use = np.repeat(np.arange(rows.num_rows), uses.value_lengths().to_numpy(zero_copy_only=False))
    names, item = np.unique(flat.field("item").to_numpy(zero_copy_only=False), return_inverse=True)
    times = flat.field("times").to_numpy(zero_copy_only=False)
    weights, count = rows["weight"].to_numpy(), rows["docs"].to_numpy().astype(np.int64)
    most = np.zeros(len(names), object)
    np.add.at(most, item, times.astype(object) * weights[of_use].astype(object) * 1_000_000)
    n_words = (n + 63) // 64
    total = np.zeros((int(most.max()).bit_length() + 1, len(names), n_words), np.uint64)
    for a in range(0, rows.num_rows, BLOCK_TERMS):
        some = rows.slice(a, BLOCK_TERMS)
        places = _bytes(some["places"].chunk(0)).view("<u2")
        scaled = _multiplied(_expanded(count[a : a + BLOCK_TERMS], places, _bytes(some["slices"].chunk(0)), n_words), weights[a : a + BLOCK_TERMS])
        mine = np.flatnonzero((of_use >= a) & (of_use < a + BLOCK_TERMS))
        for bit in range(int(times[mine].max(initial=0)).bit_length()):
            with_bit = mine[(times[mine] >> bit) & 1 == 1]
            with_bit = with_bit[np.argsort(item[with_bit], kind="stable")]
            turn = np.arange(len(with_bit)) - np.searchsorted(item[with_bit], item[with_bit])
            for t in range(int(turn.max(initial=-1)) + 1):  # each item adds one of its terms
                now = with_bit[turn == t]
                part = total[:, item[now]]
                _add(part, scaled[: len(total) - bit, of_use[now] - a], bit)
                total[:, item[now]] = part
    items, docs, score = best(total, k)
    return names[items], ids[docs], known[docs] == 0, score


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. ``index`` should be a written table: it is read twice."""
    asked = _item_terms(items, id_col, text_col)
    n_items, n_pairs = asked.agg(F.count_distinct("item"), F.count("*")).first()
    near = F.broadcast if n_pairs <= BROADCAST_PAIRS else lambda df: df
    found = index.select("term", "docs").join(near(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("docs").alias("df"))
    blocks_of_items = max(1, math.ceil(n_items / BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks_of_items))
    terms = asked.join(found, "term").groupBy("term", block.alias("block")).agg(F.first("df").alias("df"), F.collect_list(F.struct("item", "times")).alias("uses"))  # at most a block's items
    terms = terms.select("term", "block", "uses", weight(F.lit(n_docs), F.col("df")).alias("weight")).where("weight > 0")
    hits = index.where("term IS NOT NULL").join(near(terms), "term").select("segment", "block", "term", "docs", "places", "slices", "weight", "uses")
    none = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("weight", "uses")]
    own = index.where("term IS NULL").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks_of_items - 1)))).select("segment", F.col("block").cast("long"), "term", "docs", "places", "slices", *none)

    def run(rows: pa.Table) -> pa.Table:
        item, doc, missing, score = _searched(rows, k) or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        return pa.table({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=missing), "score": pa.array(score, pa.int64())})

    each = hits.unionByName(own).groupBy("segment", "block").applyInArrow(run, "item long, doc_id long, score long")
    names = asked.select("item", "item_id").distinct()
    return _ranked(each, k).join(near(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index all documents, then search for every item; the index is removed when the result is written."""
    index, n_docs = build_index(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    try:
        return checkpoint(search(scratch.keep(index), n_docs, items, k, item_id_col, item_text_col))
    finally:
        scratch.remove()


#: The contract's pattern of terms and its formulas.
ORACLE = """
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), p AS MATERIALIZED (
  SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY d, term
), l AS (
  SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY d
), c AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term
), q AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY i, item_id, term
), s AS (
  SELECT i, any_value(item_id) AS item_id, p.d, any_value(p.doc_id) AS doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN l USING (d), c
  GROUP BY i, p.d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
