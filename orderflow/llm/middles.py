"""Fill-in-middle rows: texts cut into prefix, middle and suffix of code points and put in another order.

Arrow does the work on whole batches: a text is a list of its code points; the flat list carries the index of its text and an ordinal
in it; the role of each code point follows from its ordinal; those of one role are lists again, and joined. A text longer than a
window goes through window by window, and its pieces are joined once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import raw, slices

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
WINDOW = 1 << 20


def units(texts: pa.Array) -> pa.ListArray:
    """Each text as a list of its code points; null is empty. Both are views of the bytes."""
    data, offsets = raw(texts)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    points = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), points)


def pieces(texts: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Three pieces of each text: its code points before low, from there to before high, and from there on."""
    lists = units(texts)
    parent, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(lists.offsets.cast(pa.int64()), parent))
    role = pc.add(pc.greater_equal(ordinal, pc.take(low, parent)).cast(pa.int8()), pc.greater_equal(ordinal, pc.take(high, parent)).cast(pa.int8()))
    out = []
    for r in range(3):
        own = pc.equal(role, r)
        ends = np.searchsorted(pc.filter(parent, own).to_numpy(), np.arange(len(texts) + 1))
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.filter(flat, own)), ""))
    return out


def long_pieces(text: pa.Array, low: int, high: int) -> list[pa.Array]:
    """pieces() of one text, a window at a time."""
    data, found, done, begin = raw(text)[0], [], 0, 0
    while begin < len(data):
        end = min(len(data), begin + WINDOW)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        window = pa.array([data[begin:end].tobytes()], pa.binary()).cast(pa.string())
        found.append(pieces(window, pa.array([low - done]), pa.array([high - done])))
        done, begin = done + pc.utf8_length(window)[0].as_py(), end
    return [pc.binary_join(pa.array([[x[r][0].as_py() for x in found]], pa.list_(pa.string())), "") for r in range(3)]


def rearranged(batch: pa.RecordBatch) -> pa.Array:
    """The output text of each row, from its text, form, and the bounds low and high."""
    texts, form, low, high = (batch.column(c) for c in ("__text", "form", "__low", "__high"))
    long = batch.num_rows == 1 and batch.column("__text").nbytes > WINDOW
    prefix, middle, suffix = long_pieces(texts, low[0].as_py(), high[0].as_py()) if long else pieces(texts, low, high)
    plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    mark = lambda psm, other: pc.if_else(plain, "", pc.if_else(spm, other, psm))
    return pc.binary_join_element_wise(mark(PREFIX, SUFFIX), pc.if_else(spm, suffix, prefix), mark(SUFFIX, PREFIX), pc.if_else(spm, prefix, suffix), mark(MIDDLE, MIDDLE), middle, "")


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text that each output was made of: split at the marks, pieces taken in the order of the text, joined."""
    plain, spm = (pc.equal(form, x).to_numpy(zero_copy_only=False) for x in ("plain", "spm"))
    split = pc.split_pattern_regex(pc.if_else(pa.array(plain), "<P><S><M>", output), "|".join(MARKS))
    first = split.offsets.to_numpy()[:-1]
    order = np.where(spm[:, None], np.stack([first + 2, first + 3, first + 1], 1), np.stack([first + 1, first + 3, first + 2], 1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(first) + 1, 3), pa.int32()), split.values.take(pa.array(order.ravel())))
    return pc.if_else(pa.array(plain), output, pc.binary_join(lists, ""))


def _drawn(key: Column, seed: int, turn: int) -> Column:
    """The turn-th group of eight hex digits of the digest of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * turn + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, moved: int = 90, spm: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n (code points), form, prefix_chars, middle_chars and output, for each row of docs.

    moved percent of the texts, drawn by seed and key, are cut at two drawn places and put as prefix, suffix, middle (psm) or, spm
    percent of those, as suffix, prefix, middle (spm). Others, empty and null texts, and texts that hold a mark are plain: their
    output is the text, empty for null, their counts null. A null key is drawn as an empty one. Rows are independent; repeated rows are treated alike.
    """
    x = docs.select(*keep, F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    x = x.withColumn("n", F.char_length("__text").cast("long"))
    h = [_drawn(F.col("__key"), seed, i) for i in range(4)]
    marked = F.col("__text").contains(MARKS[0]) | F.col("__text").contains(MARKS[1]) | F.col("__text").contains(MARKS[2])
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= moved), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    x = x.withColumns({"form": form, "__one": h[0] % (F.col("n") + 1), "__two": h[1] % (F.col("n") + 1)})
    plain = F.col("form") == "plain"
    x = x.withColumns({"__low": F.when(plain, F.col("n")).otherwise(F.least("__one", "__two")), "__high": F.when(plain, F.col("n")).otherwise(F.greatest("__one", "__two"))})
    x = x.withColumns({"prefix_chars": F.when(~plain, F.col("__low")), "middle_chars": F.when(~plain, F.col("__high") - F.col("__low"))})
    names = [*keep, "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", WINDOW):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), rearranged(batch)], names=[*names, "output"])

    schema = T.StructType([*(x.schema[c] for c in names), T.StructField("output", T.StringType())])
    return x.select(*names, "__text", "__low", "__high").mapInArrow(run, schema)


def restore(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, output, and restored: the text rebuilt from output and form. A null output or form gives null."""
    names = list(dict.fromkeys([*keep, "form", "output"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output", WINDOW):
            known = pc.and_(pc.is_valid(batch.column("output")), pc.is_valid(batch.column("form")))
            text = rebuilt(pc.fill_null(batch.column("output"), ""), pc.if_else(known, batch.column("form"), "plain"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pc.if_else(known, text, pa.scalar(None, pa.string()))], names=[*names, "restored"])

    return rows.select(*names).mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("restored", T.StringType())]))


def middle_table(docs: DataFrame) -> DataFrame:
    """fill_in_middle with digests of the output and of the text rebuilt from it."""
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    x = restore(fill_in_middle(docs), columns)
    return x.select(*columns, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS two,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
cuts AS (SELECT *, least(one, two) AS low, greatest(one, two) AS high FROM drawn),
pieces AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1, n) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
