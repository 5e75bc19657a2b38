"""Secret scan: three fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least `WINDOW` characters of base64 or URL-safe alphabets. For each of
the character classes (hexadecimal digits; the whole alphabet) a window slides over the run.
The state is one count per character of the class, packed into longs, and the sum S of c*log2(c) over
the counts; entering and leaving characters change two counts and four terms, and the entropy of a
window of w characters is log2(w) - S/w. Windows at or over the class's threshold become a span.
Spans that meet a pattern's span, or whose text an allow-list pattern matches, are left out.

All of it is column expressions in one projection: no shuffle, no Python, and the only state is
a row's. Positions are code points. Java's regular expressions have no "all positions", so a
match's start is the length of what `split` leaves before it plus the matches before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.shared import documents

# Fixed patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window; at most 31, as a count has five bits.
WINDOW = 24
#: Counts in a long.
PACKED = 12
#: Sizes that are summed into one growing array.
SUM_BLOCK = 256
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Class: its characters and the least entropy of a window, in bits.
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 3.05),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 4.02),
}
#: Candidates that hold one of these are no secrets: UUIDs, digits with hyphens, words in lower case joined by marks, examples.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9-]+$",
    r"^[/_=+-]*[A-Za-z]?[a-z]+([/_=+-]+[A-Za-z]?[a-z]+)*[/_=+-]*$",
    r"(?i)example|placeholder|changeme",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once. Without it, each use inside a lambda would compute it anew."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: int, merge: Callable[[Column, Column], Column], block: int = SUM_BLOCK) -> Column:
    """What merge makes of zero and the ints before each: within blocks, then over blocks, as a growing array is copied at each step."""

    def within(part: Column, base: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of_blocks(parts: Column) -> Column:
        folded = F.transform(parts, lambda part: F.aggregate(part, F.lit(zero), merge))
        return let(within(folded, F.lit(zero)), lambda bases: F.flatten(F.zip_with(parts, bases, within)))

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    return F.when(F.size(values) > 0, let(F.transform(numbers, lambda k: F.slice(values, k * block + 1, block)), of_blocks)).otherwise(F.array().cast("array<int>"))


def without_overlap(found: Column, base: Column) -> Column:
    """The spans (s, e) of found that meet no span (start, end) of base."""
    far = (1 << 31) - 1
    both = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("s"), F.lit(0).alias("own"), b["end"].alias("e"))), F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"))),
    ))

    def apart(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(-1)), -1, lambda a, b: F.greatest(a, b))
        begins = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["own"] == 0, x["s"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        free = lambda bounds: F.filter(spans, lambda x, i: (x["own"] == 1) & (F.get(bounds["ends"], i) <= x["s"]) & (F.get(bounds["begins"], i) >= x["e"]))
        return F.transform(let(F.struct(ends.alias("ends"), begins.alias("begins")), free), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(both, apart))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>> of the leftmost non-overlapping matches: start, end (exclusive) and text."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def placed(found: Column, gaps: Column) -> Column:
        # What stands before the end of match i are the gaps up to its own and the matches before it.
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        span = lambda m, at: F.struct((at - F.length(m)).alias("s"), at.alias("e"), m.alias("m"))
        return let(sizes, lambda each: F.zip_with(found, F.zip_with(running(each, 0, lambda a, b: a + b), each, lambda a, b: a + b), span))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(found, gaps))),
    )


def _weight(count: Column) -> Column:
    """c*log2(c), 0 for no or one character; from a table, as there are few counts."""
    return F.get(F.lit([0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]), count.cast("int"))


def window_span(chars: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """struct<s,e>: from the first to behind the last window whose entropy reaches `least`; null if none does. chars: a run, split into characters.

    Characters outside the class end a window: a window counts only if all its characters are of the class. Counts
    have five bits each, `PACKED` of them in a long, so a step changes a handful of numbers whatever the alphabet.
    """
    if not 0 < window <= WINDOW:
        raise ValueError(f"window must lie in 1..{WINDOW}")
    codes = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c))
    words = len(alphabet) // PACKED + 1
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("n"), F.lit(0.0).alias("w"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    units = F.lit([1 << (5 * k) for k in range(PACKED)]).cast("array<long>")
    word = lambda code: F.floor(code / PACKED).cast("int")
    unit = lambda code: F.get(units, F.pmod(code, F.lit(PACKED)))
    count = lambda n, code: F.call_function("shiftright", F.get(n, word(code)), 5 * F.pmod(code, F.lit(PACKED))).bitwiseAND(F.lit(31))

    def moved(n: Column, code: Column, by: int) -> Column:
        return let(F.struct(word(code).alias("k"), (unit(code) * by).alias("u")), lambda x: F.transform(n, lambda c, k: F.when(k == x["k"], c + x["u"]).otherwise(c)))

    def enter(acc: Column, new: Column) -> Column:
        there = count(acc["n"], new)
        return F.struct(moved(acc["n"], new, 1).alias("n"), (acc["w"] + _weight(there + 1) - _weight(there)).alias("w"))

    def leave(acc: Column, old: Column) -> Column:
        there = count(acc["n"], old)
        return F.when(old >= 0, F.struct(moved(acc["n"], old, -1).alias("n"), (acc["w"] + _weight(there - 1) - _weight(there)).alias("w"))).otherwise(acc)

    def step(acc: Column, x: Column) -> Column:
        def state(now: Column) -> Column:
            hit = (x["i"] >= window - 1) & (count(now["n"], F.lit(0)) == 0) & (math.log2(window) - now["w"] / window >= least)
            first = F.when(hit & (acc["s"] < 0), x["i"] - (window - 1)).otherwise(acc["s"])
            return F.struct(now["n"].alias("n"), now["w"].alias("w"), first.alias("s"), F.when(hit, x["i"] + 1).otherwise(acc["e"]).alias("e"))

        # What leaves goes first, so no count exceeds the window.
        left = leave(F.struct(acc["n"].alias("n"), acc["w"].alias("w")), x["old"])
        return let(left, lambda out: let(enter(out, x["new"]), state))

    def slide(code: Column) -> Column:
        moves = F.transform(code, lambda new, i: F.struct(i.alias("i"), new.alias("new"), F.coalesce(F.get(code, i - window), F.lit(-1)).alias("old")))
        return F.aggregate(moves, start, step, lambda acc: F.when(acc["s"] >= 0, F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))

    return let(codes, slide)


def allowed(run: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    found = F.lit(False)
    for pattern in allow:
        found = found | run.rlike(pattern)
    return found


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Adds `secrets`: array<struct<start,kind_no,kind,end>> in order of start, then of KINDS.

    Uses the column text only; null is an empty text and has no spans. Rows are taken one by one, so repeated rows
    need no rule; extra columns pass through, but for one named `secrets` in any case, which is replaced. Time and
    memory are linear in the text, in the number of matches and in the length of a run.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    spans = {
        "assign": F.filter(match_spans(t, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= ASSIGN_VALUE),
        "access": match_spans(t, ACCESS),
        "hex": match_spans(t, HEX),
    }

    def named(array: Column, kind: str) -> Column:
        return F.transform(array, lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), x["e"].alias("end")))

    def of_run(run: Column) -> Column:
        classes = let(F.split(run["m"], ""), lambda chars: F.array(*[window_span(chars, alphabet, least) for alphabet, least in CLASSES.values()]))
        return let(
            F.filter(classes, lambda x: x.isNotNull()),
            lambda inside: F.when(
                F.size(inside) > 0,
                F.struct(
                    (run["s"] + F.array_min(F.transform(inside, lambda x: x["s"]))).alias("s"),
                    (run["s"] + F.array_max(F.transform(inside, lambda x: x["e"]))).alias("e"),
                ),
            ),
        )

    def of_text(base: Column) -> Column:
        runs = F.filter(match_spans(t, CANDIDATE), lambda x: ~allowed(x["m"], allow))
        found = F.filter(F.transform(runs, of_run), lambda x: x.isNotNull())
        return let(found, lambda x: F.array_sort(F.concat(base, named(without_overlap(x, base), "entropy"))))

    return docs.withColumn("secrets", let(F.concat(*[named(a, k) for k, a in spans.items()]), of_text))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    allow = " or ".join(f"regexp_matches(m, {quoted(p)})" for p in ALLOW)
    spans = lambda pattern, kind, no: f"""
  select r, {no} as kind_no, '{kind}' as kind, m[i] as m,
    list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) as s
  from (select r, m, g, unnest(range(1, len(m) + 1)) as i
    from (select r, regexp_extract_all(t, {quoted(pattern)}) as m, regexp_split_to_array(t, {quoted(pattern)}) as g from d))"""  # noqa: E731
    classes = " union all ".join(
        f"select q, p from (select q, p, x, count(*) as c from ch group by q, p, x) group by q, p "
        f"having bool_and(contains({quoted(chars)}, x)) and log2({WINDOW}) - sum(case when c > 1 then c * log2(c) else 0 end) / {WINDOW} >= {least}"
        for chars, least in CLASSES.values()
    )
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
base as (
  select r, kind_no, kind, s::bigint as s, (s + length(m))::bigint as e from ({spans(ASSIGN, "assign", 0)}) where length(regexp_extract(m, {quoted(ASSIGN)}, 1)) >= {ASSIGN_VALUE}
  union all select r, kind_no, kind, s::bigint, (s + length(m))::bigint from ({spans(ACCESS, "access", 1)})
  union all select r, kind_no, kind, s::bigint, (s + length(m))::bigint from ({spans(HEX, "hex", 2)})
),
runs as (select row_number() over () as q, * from ({spans(CANDIDATE, "entropy", 3)}) where not ({allow})),
win as (select q, m, unnest(range(0, length(m) - {WINDOW} + 1)) as p from runs),
ch as (select q, p, substr(m, p + o + 1, 1) as x from (select q, m, p, unnest(range(0, {WINDOW})) as o from win)),
hit as ({classes}),
free as (
  select r, kind_no, kind, s, e from (
    select any_value(r) as r, any_value(kind_no) as kind_no, any_value(kind) as kind, (any_value(s) + min(p))::bigint as s, (any_value(s) + max(p) + {WINDOW})::bigint as e from hit join runs using (q) group by q
  ) f where not exists (select 1 from base b where b.r = f.r and b.s < f.e and f.s < b.e)
),
every as (select * from base union all select * from free)
select doc_id,
  count(*) filter (where kind = 'assign')::bigint as n_assign, count(*) filter (where kind = 'access')::bigint as n_access, count(*) filter (where kind = 'hex')::bigint as n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (where kind <> 'entropy'), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, kind_no) filter (where kind is not null), '') as spans
from d left join every using (r) group by r, doc_id
"""


SQL = _sql()
