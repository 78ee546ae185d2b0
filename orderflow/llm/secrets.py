"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's expression yields a Boolean query over the trigrams that any match must hold: an AND of clauses, each an
OR of strings, each an AND of its trigrams. The trigrams of every text are taken once; the postings of those that some
query names are joined to the queries and intersected by counting. Documents that satisfy a rule's query are scanned by
its expression, which decides. Rules without a mandatory trigram scan every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

try:
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # older Pythons
    import sre_constants as K
    import sre_parse as parser

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind, expression (one dialect for Java, RE2 and Python), and the characters that group must have at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds come first, as they are counted.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of strings (lower case, 3 characters or more): every match holds, of each clause, one of its strings."""
    clauses: list[list[str]] = []

    def flush(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            clauses.append(sorted(strings))

    def exact(tree) -> set[str] | None:
        """All strings that the tree matches, if they are few."""
        found = {""}
        for op, value in tree:
            if op is K.LITERAL:
                part = {chr(value).lower()}
            elif op is K.IN and all(o is K.LITERAL for o, _ in value):
                part = {chr(v).lower() for _, v in value}
            elif op is K.BRANCH:
                each = [exact(x) for x in value[1]]
                part = None if None in each else set().union(*each)
            elif op is K.SUBPATTERN:
                part = exact(value[-1])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] <= 3:
                once = exact(value[2])
                part = None if once is None else {"" if not n else "".join([x] * n) for n in range(value[0], value[1] + 1) for x in once} if value[1] <= 1 or len(once) == 1 else None
            else:
                part = None
            if part is None or len(found) * len(part) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in part}
        return found

    def walk(tree) -> None:
        run = {""}
        for item in tree:
            op, value = item
            part = exact([item])
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = {""} if part is None else part
            if op is K.SUBPATTERN:
                walk(value[-1])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
                walk(value[2])
        flush(run)

    walk(parser.parse(pattern))
    return [c for c in clauses if c != [""]]


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """mark, kinds: the rules whose trigram queries a text satisfies, from postings of its trigrams. docs: mark, text.

    A text is cut into threes at its first three places, which gives every trigram; those that some query names are its
    postings. Queries are intersected by counting them.
    """
    rows = [(r.kind, c, a, len(trigrams(s)), t) for r in rules for c, clause in enumerate(trigram_query(r.pattern)) for a, s in enumerate(clause) for t in trigrams(s)]
    clauses = {r.kind: len(trigram_query(r.pattern)) for r in rules}
    named = F.array(*map(F.lit, sorted({x[-1] for x in rows})))
    queries = docs.sparkSession.createDataFrame(rows, "kind string, clause int, choice int, needs int, trigram string")
    threes = [F.regexp_extract_all(F.substring(F.lower("text"), i, F.length(F.lower("text"))), F.lit("(?s).{3}"), F.lit(0)) for i in (1, 2, 3)]
    postings = docs.select("mark", F.explode(F.array_intersect(F.concat(*threes), named)).alias("trigram")).distinct()
    held = postings.join(F.broadcast(queries), "trigram")  # as many rows as the rules name trigrams
    choices = held.groupBy("mark", "kind", "clause", "choice").agg(F.count(F.lit(1)).alias("n"), F.first("needs").alias("needs")).filter("n = needs")
    met = choices.groupBy("mark", "kind").agg(F.countDistinct("clause").alias("n"))
    needs = F.create_map(*(F.lit(x) for kv in clauses.items() for x in kv))
    return met.filter(F.col("n") == F.element_at(needs, F.col("kind"))).groupBy("mark").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (order, place, gap, size, kept) of the rule's matches, leftmost and not overlapping, in code points.

    gap: from the match before it; kept: characters of the group that counts.
    """
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    sizes, kept = F.transform(found, F.char_length), F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.char_length)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"), kept.alias("kept"))
    return F.transform(rows, lambda x, i: F.struct(F.lit(order).alias("order"), i.alias("place"), x["gap"].alias("gap"), x["size"].alias("size"), x["kept"].alias("kept")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found: array of (start, order, kind, end) by start, then kind as listed, for each row of docs.

    Whole texts; null is empty and has none. Texts are known by a hash, under which the index may only propose too much:
    the expressions decide, for each row. Matches are rows, whose places are running sums of gaps and sizes, so a text may
    have any number. Equal rows share a result; an empty table gives no rows; further columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    x = base.join(candidates(base.select("mark", "text"), indexed), "mark", "left")
    none = F.array().cast("array<struct<order:int,place:int,gap:int,size:int,kept:int>>")
    found = []
    for order, rule in enumerate(rules):
        wanted = F.array_contains("kinds", rule.kind) if rule in indexed else F.lit(True)
        found.append(F.when(wanted & F.col("text").rlike(rule.pattern), matches(F.col("text"), rule, order)).otherwise(none))
    rows = x.select("doc_id", "mark", F.inline(F.concat(*found))).distinct()
    so_far = Window.partitionBy("doc_id", "mark", "order").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    kinds, least = (F.array(*[F.lit(v) for v in values]) for values in ([r.kind for r in rules], [r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), "order", F.get(kinds, F.col("order")).alias("kind"), F.col("end").cast("int").alias("end"))
    kept = rows.withColumn("end", end).filter(F.col("kept") >= F.get(least, F.col("order")))
    spans = kept.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("m")).agg(F.array_sort(F.collect_list(span)).alias("found"))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    told = base.select("doc_id", "mark").join(spans, (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return told.select("doc_id", F.coalesce("found", empty).alias("found"))


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans of each base kind, digest of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, by plain scans."""
    rows = []
    for order, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        rows.append(
            f"""SELECT doc_id, {order} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap,
            unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {r.group})) AS g, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d"""
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(rows)}),
    p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM m),
    s AS (SELECT doc_id, k, kind, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM p WHERE length(g) >= least),
    a AS (SELECT doc_id, {counts}, string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, k) FILTER (k < {len(BASE)}) AS base, string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, k) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
