"""Secret scanning with an inverted trigram index, in DataFrame functions only.

Each rule is a regular expression.  From its parse tree a Boolean query over lower-case
trigrams is derived (any of several sets, all of a set).  The index holds the postings of
the trigrams that some rule needs: (trigram, key of a text), the key being the text's
SHA-256, so copies of a text are one entry.  Posting lists are intersected by an aggregate
over the keys, and the texts that are left are verified with the expressions themselves;
rules without a mandatory trigram scan every text.

Nulls count as the empty text.  Rows are judged one by one, so repeated rows repeat
their result and other columns pass through.  Time is linear in the text and almost so
in the number of matches of one rule in one text (``CHUNK`` of them at a time).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.common import free_name


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds in Java's and Python's syntax; a match stands if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules.  A maximal run of 24 or more is what is left of all maximal runs after
#: dropping shorter ones, and likewise for the access rule, whose match always ends its run.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)

#: Forms of further credentials, beside the base rules.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

#: Matches whose spans are gathered at a time.
CHUNK = 256
#: Parts into which the rows of one text are dealt when they meet its candidates.
SALTS = 32

#: A rule with more alternatives than this scans every row.
ALTERNATIVES = 64
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams; a text that matches holds every trigram of some set.  One empty set: no condition."""
    states = _walk(rp.parse(pattern), {((), "")})
    sets = {frozenset(f[i : i + 3] for f in (*done, tail) for i in range(len(f) - 2)) for done, tail in states}
    if len(states) > ALTERNATIVES or not all(sets):
        return [frozenset()]
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def _closed(states: set) -> set:
    """Whatever may come next, the literal run ends here."""
    return {((*done, tail) if len(tail) > 2 else done, "") for done, tail in states}


def _walk(tree, states: set) -> set:
    for op, arg in tree:
        if len(states) > ALTERNATIVES:
            return states
        if op is rc.LITERAL:
            states = {(done, tail + chr(arg).lower()) for done, tail in states}
        elif op is rc.SUBPATTERN:
            states = _walk(arg[3], states)
        elif op is rc.BRANCH:
            states = set().union(*(_walk(branch, states) for branch in arg[1]))
        elif op is rc.IN and len(arg) <= 4 and all(o is rc.LITERAL for o, _ in arg):
            states = {(done, tail + chr(c).lower()) for done, tail in states for _, c in arg}
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, sub = arg
            once = _walk(sub, states) if least else states
            if (least, most) == (0, 1):
                states = states | _walk(sub, states)
            elif (least, most) != (1, 1):
                states = _closed(once)
        elif op not in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            states = _closed(states)
    return states


def needed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams of all rules' queries."""
    return sorted(set().union(*(q for r in rules for q in trigram_query(r.pattern))))


def text_key(text: str = "text") -> Column:
    """What texts are known by in the index: 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The index: a row (trigram, key) for each needed trigram that a text holds.  Copies of a text may repeat their rows."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = F.filter(F.array(*map(F.lit, needed_trigrams(rules))).cast("array<string>"), lambda t: F.contains(low, t))
    return docs.select(text_key(text).alias("key"), F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the numbers of the rules whose query the postings of a text satisfy, for texts that have any."""
    merged = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    passed = []
    for k, rule in enumerate(rules):
        either = F.lit(False)
        for wanted in trigram_query(rule.pattern):
            if wanted:
                both = F.lit(True)
                for t in sorted(wanted):
                    both = both & F.array_contains("held", t)
                either = either | both
        passed.append(F.when(either, F.lit(k)))
    return merged.select("key", F.array_compact(F.array(*passed)).alias("rules")).filter(F.size("rules") > 0)


def _spans(rule: Rule, kind: int, text: Column) -> Column:
    """Code point spans of the matches that stand: the pieces between matches and the matches tile the text."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(hits, F.char_length).alias("size"),
        F.transform(held, F.char_length).alias("held"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        spans = F.when(x["held"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(F.coalesce(stop, acc["at"]).alias("at"), spans.alias("spans"))  # the last gap has no match

    def chunk(acc: Column, k: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("spans"))
        done = F.aggregate(F.slice(sizes, k * CHUNK + 1, CHUNK), begin, step)
        return F.struct(done["at"].alias("at"), F.concat(acc["spans"], F.array(done["spans"])).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(hits) / CHUNK)).cast("int"))
    return F.aggregate(chunks, begin, chunk, lambda acc: F.flatten(acc["spans"]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """Add the column ``spans``: (start, kind, stop) of every match, by start, then kind's place in ``rules``; stop is exclusive.

    The rows of one text are dealt to ``SALTS`` parts by their partition, so many copies don't meet in one task.
    """
    names = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    key, salt, mine = (free_name(docs, n) for n in ("_key", "_salt", "_rules"))
    found = candidates(postings(docs, rules, text), rules)
    dealt = found.select(F.col("key").alias(key), F.col("rules").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    keyed = docs.withColumn(key, text_key(text)).withColumn(salt, F.spark_partition_id() % SALTS)
    joined = keyed.join(dealt, [key, salt], "left")
    none = F.array().cast(SPAN)
    made = []
    for k, rule in enumerate(rules):
        ready = whole.rlike(rule.pattern)
        if all(trigram_query(rule.pattern)):
            ready = F.coalesce(F.array_contains(mine, k), F.lit(False)) & ready
        made.append(F.when(ready, _spans(rule, k, whole)).otherwise(none))
    return joined.select(*names, F.array_sort(F.concat(*made)).alias(spans))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Replace each secret (overlapping spans as one) in ``text`` by its kind in square brackets; other rows and columns stay as they are."""
    names = docs.columns
    kinds = F.array(*(F.lit(f"[{r.kind.upper()}]") for r in rules))
    source = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.substring(source, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["out"], kept, kinds[x["kind"]])).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["stop"]).alias("at"),
        )

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(source, acc["at"] + 1, F.char_length(source)))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    spans = free_name(docs, "_spans")
    clean = F.aggregate(spans, begin, step, rest)
    return find_secrets(docs, rules, text, spans).withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(source)).select(*names)


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def secret_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, a count a base rule, the digest of the base spans and all spans as text."""
    found = find_secrets(docs.select(key, text), RULES, text, "_spans")
    counts = [_count("_spans", k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    base = F.filter("_spans", lambda x: x["kind"] < len(BASE_RULES))
    return found.select(key, *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("_spans")).alias("spans"))


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


def duckdb_sql() -> str:
    """The query's rows in DuckDB; the positions come from the same tiling."""
    assign = BASE_RULES[0].pattern.removeprefix("(?i)")
    words, rest = assign[: assign.index(")") + 1], assign[assign.index(")") + 1 :]
    patterns = {"assign": (_either_case(words) + rest, 2, 6), "access": (BASE_RULES[1].pattern, 0, 0), "hex": ("[0-9a-f]{24,}", 0, 0)}
    patterns |= {r.kind: (r.pattern, r.group, r.least) for r in MORE_RULES}
    parts = []
    for k, (kind, (pattern, group, least)) in enumerate(patterns.items()):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT r, {k} AS k, '{kind}' AS kind, s.start AS start, s.start + s.size AS stop FROM (
  SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'size': length(m[i]), 'held': length(v[i])}})) AS s
  FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS g FROM d) WHERE len(m) > 0) WHERE s.held >= {least}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
