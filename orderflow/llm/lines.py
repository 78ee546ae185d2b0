"""Line deduplication by a segment-partition edit join.

Lines of which one turns into the other by a few edits share, at nearly the same place, one of threshold-plus-one
segments. Every line is entered in an index by its own segments, and probes it with its substrings at the places that
the segments of an equally long or a little shorter line could have; keys hold the length and the segment's number.
Lines that meet at a key are verified by a banded bit-parallel edit distance.

Where many lines meet at one key, they are not paired as they are. Each is keyed anew by the parity of its bigrams,
in parts to which bigrams are hashed: one edit changes four bigrams at most, so of 4 * threshold + 1 parts one at least
is equal in both lines. Of those that agree in a part only lines are paired whose parities differ in 4 * threshold bits
at most. Lines of one template agree in most parts, so large groups are split into blocks, and two blocks at a time
are compared, each pair of them in a task of its own.

How many edits link two lines grows with the shorter one: none below 16 characters, one below 32, then two. Where
few characters leave few other lines, an edit tells words apart, not copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shuffle_partitions
from .neighbours import whole_groups
from .text import digest, mix, prefix_sums, slices, sums_between

#: Lines of so many characters or more are linked by one edit, and by two.
NEAR_CHARS = (16, 32)
BLOCK = 1000
SLICE_BYTES = 1 << 19
MANY = 8


def within(a: str, b: str, k: int) -> bool:
    """Whether k edits (insert, delete, replace a character) or fewer turn a into b.

    What both begin and end with is left aside. The rest is walked column by column with the differences between
    neighbouring cells as bits, of which only the 2k + 1 cells about the diagonal are kept.
    """
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    i = _common(a, b, n)
    j = _common(a[::-1], b[::-1], n - i)
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= k or not a:
        return len(b) <= k
    # While column c is made, row r is at bit r - c + k. Column 0 reads r for r >= 0; rows past the end of a match nothing.
    width = 2 * k + 1
    ones = (1 << width) - 1
    where: dict[str, int] = {}
    for r, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << r
    up, down, score = ones ^ ((1 << k) - 1), 0, k
    # score follows the lowest kept row, at first row k; up/down: the cell is one more/less than the cell above it,
    # moved by one bit for the next column.
    for c, x in enumerate(b, 1):
        rows = where.get(x, 0)  # bit r: row r + 1 has x
        shift = c - k - 1  # the row of bit 0 is shift + 1
        same = (rows >> shift if shift >= 0 else rows << -shift) & ones
        diagonal = ((((same & up) + up) ^ up) | same | down) & ones
        right_up, right_down = (down | ~(diagonal | up)) & ones, diagonal & up
        score += not diagonal >> (width - 1) & 1
        shifted = diagonal >> 1
        up, down = (right_down | ~(shifted | right_up)) & ones, shifted & right_up
    # From the lowest kept row, len(b) + k, back up to row len(a).
    for r in range(len(b) + k, len(a), -1):
        bit = 1 << (r - len(b) - 1 + k)
        score += bool(down & bit) - bool(up & bit)
    return score <= k


def allowed(chars: int, near: tuple[int, ...] = NEAR_CHARS) -> int:
    """Edits that may part a line of so many characters from one as long or longer."""
    return sum(chars >= n for n in near)


def _common(a: str, b: str, n: int) -> int:
    """Length of the common beginning, at most n."""
    low, high = 0, n
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def segments(length: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where each of k + 1 even segments begins in lines of these lengths, and how long it is."""
    short, more = length // (k + 1), length % (k + 1)
    out, at = [], np.zeros_like(length)
    for i in range(k + 1):
        size = short + (i >= k + 1 - more)
        out.append((at, size))
        at = at + size
    return out


def line_keys(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int, least: int, below: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the line each is of, and whether it is a probe, for pairs whose shorter line has least characters or more, and less than below."""
    keys, lines, probes = [], [], []
    sums = prefix_sums(symbols)
    below = int(lengths.max(initial=0)) + 1 if below is None else below

    def add(ok: np.ndarray, at: np.ndarray, size: np.ndarray, of: np.ndarray, i: int, probe: bool) -> None:
        some = np.flatnonzero(ok)
        begin = (starts + at)[some]
        salt = of[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1 + 16 * k)
        keys.append(mix(sums_between(sums, begin, begin + size[some]) ^ mix(salt)))
        lines.append(some)
        probes.append(np.full(len(some), probe))

    own = (lengths >= least) & (lengths < below)
    for i, (at, size) in enumerate(segments(lengths, k)):
        add(own, at, size, lengths, i, False)
    for less in range(k + 1):
        of = lengths - less
        ok = (of >= least) & (of < below)
        for i, (at, size) in enumerate(segments(np.maximum(of, 0), k)):
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                add(ok & (at + shift >= 0) & (at + shift + size <= lengths), at + shift, size, of, i, True)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(probes)


def near_keys(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, near: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of line_keys for each number of edits with the lengths that it holds for."""
    found = [line_keys(symbols, starts, lengths, k, least, below) for k, least, below in zip(range(1, len(near) + 1), near, (*near[1:], None))]
    return tuple(np.concatenate(x) for x in zip(*found))


class Lines:
    """Lines of a batch: texts split at line feeds. Blank ones (of white space only) take no part."""

    def __init__(self, texts: list[str]):
        self.code = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        breaks = np.flatnonzero(self.code == 10)
        starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(self.code)]])
        counts = np.array([t.count("\n") + 1 for t in texts])
        doc = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        ink = np.concatenate([[0], np.cumsum((self.code != 32) & ((self.code < 9) | (self.code > 13)))])
        some = ink[ends] > ink[starts]
        self.starts, self.ends, self.doc, self.number = starts[some], ends[some], doc[some], number[some]
        self.symbols = mix(self.code.astype(np.uint64) + np.uint64(1))
        width = 1 + (self.code >= 0x80).astype(np.int64) + (self.code >= 0x800) + (self.code >= 0x10000)
        byte, origin = np.concatenate([[0], np.cumsum(width)]), starts[np.cumsum(counts) - counts][self.doc]
        self.begin, self.end = (byte[at] - byte[origin] for at in (self.starts, self.ends))
        names = b"".join(digest(self.code[a:b], 16) for a, b in zip(self.starts.tolist(), self.ends.tolist()))
        self.first, self.second = np.frombuffer(names, np.int64).reshape(-1, 2).T


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), text, without null texts. Rows that agree in id and text are one document."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), "text")


def occurrences(texts: DataFrame) -> DataFrame:
    """first, second (digest of a line), doc_id, mark, line (from 0), chars, begin, end (in bytes) of each line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            x = Lines(batch.column("text").to_pylist())
            doc = pa.array(x.doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.first), pa.array(x.second), batch.column("doc_id").take(doc), batch.column("mark").take(doc), pa.array(x.number.astype(np.int32)), *(pa.array(v.astype(np.int32)) for v in (x.ends - x.starts, x.begin, x.end))],
                names=["first", "second", "doc_id", "mark", "line", "chars", "begin", "end"],
            )

    return texts.mapInArrow(run, "first long, second long, doc_id long, mark long, line int, chars int, begin int, end int")


def meetings(texts: DataFrame, near: tuple[int, ...], parts: int) -> DataFrame:
    """key, a, b: fingerprints of lines that meet at a key, a the indexed one. Where many meet, b is null."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            x = Lines(batch.column("text").to_pylist())
            _, once = np.unique(x.first, return_index=True)
            once = once[(x.ends - x.starts)[once] >= near[0]]
            if not len(once):
                continue
            keys, lines, probe = near_keys(x.symbols, x.starts[once], (x.ends - x.starts)[once], near)
            names = x.first[once][lines]
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            low = np.ascontiguousarray((keys[order] & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6])
            names, probe = names[order], probe[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges))
            cells = [[v[edges[p] : edges[p + 1]] for v in (low, names, probe)] for p in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([c[0].tobytes() for c in cells], pa.binary()), pa.array([c[1].tobytes() for c in cells], pa.binary()), pa.array([np.packbits(c[2]).tobytes() for c in cells], pa.binary())],
                names=["part", "keys", "names", "probes"],
            )

    def meet(table: pa.Table) -> pa.Table:
        names = [np.frombuffer(v, np.int64) for v in table.column("names").to_pylist()]
        probe = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=len(n)) for v, n in zip(table.column("probes").to_pylist(), names)])
        keys = np.zeros((len(probe), 8), np.uint8)
        keys[:, :6] = np.concatenate([np.frombuffer(v, np.uint8).reshape(-1, 6) for v in table.column("keys").to_pylist()])
        keys, names = keys.view(np.uint64).ravel(), np.concatenate(names)
        order = np.lexsort((names, probe, keys))
        keys, names, probe = keys[order], names[order], probe[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (probe[1:] != probe[:-1]) | (names[1:] != names[:-1])
        keys, names, probe = keys[new], names[new], probe[new]
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        turn = np.concatenate([[0], np.cumsum(probe, dtype=np.int64)])
        probes = turn[bounds[1:]] - turn[bounds[:-1]]
        indexed = np.diff(bounds) - probes
        out: list[tuple[int, np.ndarray, np.ndarray | None]] = []
        different = np.minimum.reduceat(names, bounds[:-1]) != np.maximum.reduceat(names, bounds[:-1])
        for g in np.flatnonzero((probes > 0) & (indexed > 0) & different):
            a, b = names[bounds[g] : bounds[g] + indexed[g]], names[bounds[g] + indexed[g] : bounds[g + 1]]
            if len(a) > MANY or len(b) > MANY:
                out.append((g, np.unique(np.concatenate([a, b])), None))
                continue
            i, j = np.nonzero(a[:, None] != b[None])
            if len(i):
                out.append((g, a[i], b[j]))
        n = [len(x[1]) for x in out]
        a = pa.array(np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.int64))
        b = np.concatenate([x[1] if x[2] is None else x[2] for x in out]) if out else np.zeros(0, np.int64)
        many = np.repeat(np.array([x[2] is None for x in out], bool), n)
        key = np.repeat(np.array([int(keys[bounds[x[0]]]) for x in out], np.int64), n)
        return pa.table({"key": pa.array(key), "a": a, "b": pa.array(b, mask=many)})

    sent = texts.select("text").mapInArrow(send, "part int, keys binary, names binary, probes binary")
    return sent.groupBy("part").applyInArrow(meet, "key long, a long, b long")


def fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, second, line: the text of each wanted line (name, second, doc_id, mark, line number)."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array([pressed(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "mark", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed", SLICE_BYTES // 2):
            found = []
            for packed, rows in zip(batch.column("packed").to_pylist(), batch.column("rows").to_pylist()):
                lines = unpress(packed).decode().split("\n")
                found += [(r["name"], r["second"], lines[r["line"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], names=["name", "second", "line"])

    by_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("name", "second", "line")).alias("rows"))
    packed = texts.mapInArrow(press, "doc_id long, mark long, packed binary")
    x = packed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    return x.select("packed", "rows").mapInArrow(read, "name long, second long, line string").distinct()


def bigram_parts(line: str, parts: int) -> list[int]:
    """Parity of the bigrams that are hashed to each part, 63 bits a part."""
    code = np.frombuffer(f"\n{line}\n".encode("utf-32-le"), "<u4").astype(np.uint64)
    hashed = mix(code[:-1] << np.uint64(32) | code[1:])
    bits = np.zeros((parts, 64), np.int64)
    np.add.at(bits, ((hashed >> np.uint64(40)) % np.uint64(parts), hashed % np.uint64(63)), 1)
    return [int(x) for x in (bits & 1) @ (np.int64(1) << np.arange(64, dtype=np.int64).clip(max=62))]


def near_lines(texts: DataFrame, firsts: DataFrame, near: tuple[int, ...], block: int) -> DataFrame:
    """a, a2, b, b2: digests of each two different lines that the allowed edits part, each pair once in either direction."""
    k = len(near)
    met = cut(meetings(texts, near, 4 * shuffle_partitions(texts.sparkSession)).distinct())
    names = met.select(F.col("a").alias("name")).unionByName(met.filter("b IS NOT NULL").select(F.col("b").alias("name"))).distinct()
    wanted = firsts.join(names, firsts["first"] == names["name"]).select("name", "second", "at.doc_id", "at.mark", "at.line")
    lines = cut(fetch(texts, wanted))
    parts = 4 * k + 1

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [bigram_parts(x, parts) for x in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("name"), pa.array(values, pa.list_(pa.int64()))], names=["key", "name", "parts"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", 2 * block):
            cells, name, side = (table.column(c).to_numpy() for c in ("cell", "name", "side"))
            parity = table.column("parts").combine_chunks().flatten().to_numpy().reshape(len(cells), parts).view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
            for a, b in zip(bounds[:-1], bounds[1:]):
                left, right = np.flatnonzero(side[a:b] <= 0) + a, np.flatnonzero(side[a:b] >= 0) + a
                for i in left:
                    others = right[name[right] > name[i]] if side[i] == 0 else right
                    flips = np.bitwise_count(parity[others] ^ parity[i]).sum(1)
                    found = others[flips <= 4 * k]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(name[found], name[i])), pa.array(np.maximum(name[found], name[i]))], names=["a", "b"])

    many = met.filter("b IS NULL").select("key", F.col("a").alias("name")).join(lines, "name").select("key", "name", "line")
    many = many.mapInArrow(again, "key long, name long, parts array<long>")
    many = cut(many.select("name", "parts", "key", F.posexplode("parts").alias("part", "value")).select(F.xxhash64("key", "part", "value").alias("key"), "name", "parts").distinct())
    sizes = many.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A line of block i goes to the cells (i, j) of all blocks j; side: -1 or 1 in the lesser or greater of two blocks, 0 in one.
    blocks = F.ceil(F.col("n") / block)
    dealt = many.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("name", F.lit(5)), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(cell.alias("cell"), "name", F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "parts")
    pairs = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(alike, "a long, b long").filter("a < b")
    pairs = pairs.unionByName(met.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([x != y and within(x, y, allowed(min(len(x), len(y)), near)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], pa.bool_())
            yield batch.select(["a", "a2", "b", "b2"]).filter(ok)

    left = lines.select(F.col("name").alias("a"), F.col("second").alias("a2"), F.col("line").alias("x"))
    right = lines.select(F.col("name").alias("b"), F.col("second").alias("b2"), F.col("line").alias("y"))
    found = pairs.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "x", "y").mapInArrow(verify, "a long, a2 long, b long, b2 long")
    found = cut(found.distinct())
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("b2").alias("a2"), F.col("a").alias("b"), F.col("a2").alias("b2")))


def dedup_lines(docs: DataFrame, near: tuple[int, ...] = NEAR_CHARS, block: int = BLOCK) -> DataFrame:
    """doc_id, mark, n_links, removed (line from 0, begin, end in bytes) for documents that lose lines or have links.

    Lines are ordered by (doc_id, null last; position). A line goes if an equal line comes earlier, or if a line that the
    allowed edits part from it comes first earlier than it does (near: from how many characters of the shorter line on one
    edit is allowed, two, ...); such a line goes whether or not the earlier one stays. Blank lines stay and link nothing. n_links: to how many other lines, each text counted
    once, the document's lines are linked by edits. Null texts have no lines; an empty table gives no rows.
    """
    texts = marked(docs)
    lines = cut(occurrences(texts))
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "line")
    firsts = cut(lines.groupBy("first", "second").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars")))
    links = near_lines(texts, firsts.filter(F.col("chars") >= near[0]), near, block)
    of = firsts.select(F.col("first").alias("b"), F.col("second").alias("b2"), F.col("at").alias("near"))
    nearest = links.join(of, ["b", "b2"]).groupBy(F.col("a").alias("first"), F.col("a2").alias("second")).agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("links"))
    told = firsts.join(nearest, ["first", "second"], "left").filter("n > 1 OR links IS NOT NULL")
    told = cut(told.select("first", "second", "at", F.coalesce(F.col("near") < F.col("at"), F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links")))
    gone = F.col("late") | ~((F.col("at.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("at.mark") == F.col("mark")) & (F.col("at.line") == F.col("line")))
    found = lines.join(told, ["first", "second"]).select("doc_id", "mark", "line", "begin", "end", "links", gone.alias("gone")).distinct()
    return found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct("line", "begin", "end")))).alias("removed"), F.sum("links").alias("n_links"))


def without_repeats(docs: DataFrame, text: str = "text", names: tuple[str, str, str] = ("n_lines", "n_removed", "n_links")) -> DataFrame:
    """docs with text replaced by its kept lines, and numbers of lines, removed lines and links added under the names.

    A null text stays null and has no lines. Columns that have one of the names already are replaced.
    """
    found = dedup_lines(docs).select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"), F.col("n_links").alias("__links"))
    x = docs.drop(*names).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__mark")), "left")
    some = F.size("__removed") > 0
    data = F.col(text).cast("binary")
    # Runs of kept lines lie between removed ones, whose line feeds go with them.
    ends = F.concat(F.transform("__removed", lambda r: r["begin"] - 1), F.array(F.octet_length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform("__removed", lambda r: r["end"] + 1))
    runs = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["a"] <= r["b"])
    kept = F.array_join(F.transform(runs, lambda r: F.substring(data, r["a"] + 1, r["b"] - r["a"]).cast("string")), "\n")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    counts = {names[0]: n_lines.cast("long"), names[1]: F.when(some, F.size("__removed")).otherwise(0).cast("long"), names[2]: F.coalesce("__links", F.lit(0)).cast("long")}
    return x.withColumns(counts | {text: F.when(some, kept).otherwise(F.col(text))}).drop("__doc", "__mark", "__removed", "__links")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, kept_sha256 for each row of docs (null text: of nothing)."""
    x = without_repeats(docs.select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
