"""DuckDB SQL for the registered queries: the same results by plain relational means."""

from __future__ import annotations

from sketchloom.functions import hashing

M64 = "18446744073709551616::uhugeint"
SEQS = "seqs as (select doc_id as id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from documents)"
BY_SOURCE = "seqs as (select substr(source, 4)::bigint as id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from documents)"
#: A 64-bit word as a signed one.
SIGNED = "(case when {0} >= 9223372036854775808::uhugeint then {0}::hugeint - 18446744073709551616::hugeint else {0}::hugeint end)::bigint"


BY_ITEM = "seqs as (select item_id as id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) as seq from benchmark)"
#: With N, and in either case until it is upper-cased.
WITH_N = "seqs as (select doc_id as id, upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) as seq from documents)"


def kmers(k: int, drop_last: int = 0) -> str:
    return f"kmers as (select id, pos, substr(seq, pos, {k}) as kmer from (select id, seq, unnest(range(1, length(seq) - {k - 2 + drop_last})) as pos from seqs where length(seq) >= {k + drop_last}))"


def rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGTN', 'TGCAC')"


def reversed_strand(seqs: str) -> str:
    """The table of sequences with their other strands."""
    return f"own_strand{seqs[4:]}, seqs as (select id, {rc('seq')} as seq from own_strand)"


def _mul(a: str, b: int) -> str:
    return f"(({a}) * {b}::uhugeint % {M64})"


def _rot(a: str, by: int) -> str:
    return f"((({a}) * {1 << by}::uhugeint % {M64}) + (({a}) // {1 << (64 - by)}::uhugeint))"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"


def _add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {M64})"


def _shift_xor(a: str, by: int) -> str:
    return _xor(a, f"({a}) // {1 << by}::uhugeint")


def fmix_steps(prefix: str, source: str, column: str, keep: str) -> list[str]:
    """Common table expressions that mix a column; the last is named prefix3."""
    return [
        f"{prefix}1 as (select {keep}, {_mul(_shift_xor(column, 33), hashing.FMIX64[0])} as {column} from {source})",
        f"{prefix}2 as (select {keep}, {_mul(_shift_xor(column, 33), hashing.FMIX64[1])} as {column} from {prefix}1)",
        f"{prefix}3 as (select {keep}, {_shift_xor(column, 33)} as {column} from {prefix}2)",
    ]


def murmur(source: str, k: int, seed: int = 42, as_hex: bool = False) -> str:
    """CTEs that end in hashes(kmer, h) for the distinct k-mers in column kmer of source. as_hex: two digits a byte."""
    c1, c2 = hashing.MURMUR128_64

    def lane(lo: int, hi: int) -> str:
        if as_hex:
            digit = lambda i: f"(instr('0123456789ABCDEF', substr(kmer, {i}, 1)) - 1)"
            return " + ".join(f"({digit(2 * i + 1)} * 16 + {digit(2 * i + 2)})::uhugeint * {1 << (8 * (i - lo))}::uhugeint" for i in range(lo, hi)) or "0::uhugeint"
        return " + ".join(f"ord(substr(kmer, {i + 1}, 1))::uhugeint * {1 << (8 * (i - lo))}::uhugeint" for i in range(lo, hi)) or "0::uhugeint"

    scramble = (lambda x: _mul(_rot(_mul(x, c1), 31), c2), lambda x: _mul(_rot(_mul(x, c2), 33), c1))
    steps = [f"m0 as (select kmer, {seed}::uhugeint as a, {seed}::uhugeint as b from (select distinct kmer from {source}))"]

    def step(a: str, b: str) -> None:
        n = len(steps)
        steps.append(f"m{n} as (select kmer, {a} as a, {b} as b from m{n - 1})")

    for at in range(0, k - k % 16, 16):
        for side, (name, other, turn) in enumerate((("a", "b", 27), ("b", "a", 31))):
            mixed = _xor(name, scramble[side](lane(at + 8 * side, at + 8 * side + 8)))
            done = _add(_mul(_add(_rot(mixed, turn), other), 5), str(hashing.MURMUR128_ADD[side]))
            step(*((done, "b") if side == 0 else ("a", done)))
    at = k - k % 16
    if k % 16:
        tails = [scramble[side](lane(at + 8 * side, min(k, at + 8 * side + 8))) if at + 8 * side < k else "0::uhugeint" for side in (0, 1)]
        step(_xor("a", tails[0]), _xor("b", tails[1]))
    step(_xor("a", f"{k}::uhugeint"), _xor("b", f"{k}::uhugeint"))
    step(_add("a", "b"), "b")
    step("a", _add("b", "a"))
    last = f"m{len(steps) - 1}"
    steps += fmix_steps("fa", last, "a", "kmer, b") + fmix_steps("fb", "fa3", "b", "kmer, a")
    steps.append(f"hashes as (select kmer, {_add('a', 'b')} as h from fb3)")
    return ",\n".join(steps)


CANONICAL = f"canon as (select id, pos, least(kmer, {rc('kmer')}) as kmer from kmers)"


def hashed(seqs: str, k: int, drop_last: int = 0) -> str:
    """CTEs that end in kh(id, pos, h). Recursive ones may follow."""
    return f"with recursive {seqs}, {kmers(k, drop_last)}, {CANONICAL}, {murmur('canon', k)}, kh as (select id, pos, h from canon join hashes using (kmer))"


def sketches(seqs: str, k: int, size: int, copies: int = 1) -> str:
    """CTEs that end in sk(id, h, multiplicity)."""
    return (
        hashed(seqs, k)
        + f""", sk as (select id, h, n as multiplicity from (
  select id, h, n, row_number() over (partition by id order by h) as r from (select id, h, count(*) as n from kh group by id, h having count(*) >= {copies})
) where r <= {size})"""
    )


def measures(seqs: str, k: int, size: int) -> str:
    """CTEs that end in measured(i, j, shared, jaccard, containment, distance) of pairs that share a hash."""
    return (
        sketches(seqs, k, size)
        + f""", lists as (select id, list(h order by h) as hs from sk group by id),
cand as (select a.id as i, b.id as j, count(*) as shared from sk a join sk b using (h) where a.id < b.id group by a.id, b.id),
tops as (select i, j, shared, a.hs as x, b.hs as y, list_slice(list_sort(list_distinct(list_concat(a.hs, b.hs))), 1, {size}) as top from cand join lists a on a.id = i join lists b on b.id = j),
jac as (select i, j, shared, len(list_intersect(list_intersect(x, y), top)) / len(top) as jaccard, shared / least(len(x), len(y)) as containment from tops),
measured as (select *, case when jaccard = 1 then 0.0 when jaccard = 0 then 1.0 else least(1.0, -ln(2 * jaccard / (1 + jaccard)) / {k}) end as distance from jac)"""
    )


def registers(seqs: str, k: int, p: int) -> str:
    """CTEs that end in regs(id, idx, rank)."""
    return (
        hashed(seqs, k, 1)
        + f""", regs as (select id, (h // {1 << (64 - p)}::uhugeint)::int as idx,
  max(65 - length(bin(((h * {1 << p}::uhugeint) % {M64} + {1 << (p - 1)}::uhugeint)::ubigint)))::int as rank from kh group by id, idx)"""
    )


def joint(p: int) -> str:
    """CTE hist(i, j, kind, rank, n) over all pairs of ids in regs."""
    return """ids as (select distinct id from regs), idpairs as (select a.id as i, b.id as j from ids a join ids b on a.id < b.id),
ra as (select i, j, idx, rank from idpairs join regs on id = i), rb as (select i, j, idx, rank from idpairs join regs on id = j),
joined as (select i, j, coalesce(ra.rank, 0) as x, coalesce(rb.rank, 0) as y from ra full join rb using (i, j, idx)),
hist as (
  select i, j, kind, rank::int as rank, count(*)::bigint as n from (
    select i, j, 'a' as kind, x as rank from joined union all select i, j, 'b', y from joined union all select i, j, 'union', greatest(x, y) from joined
    union all select i, j, case when x > y then 'a_more' when y > x then 'b_more' else 'equal' end, greatest(x, y) from joined
  ) group by i, j, kind, rank
)"""


def original(p: int) -> str:
    """Expression of the first estimator over columns s (sum of 2^-rank with zeros) and zeros."""
    from sketchloom.operators.hll import alpha

    m = float(1 << p)
    raw = f"({alpha(1 << p) * m * m!r} / s)"
    return f"case when {raw} < {2.5 * m} then case when zeros > 0 then {m} * ln({m} / zeros) else {raw} end else {raw} end"


def minimizers(seqs: str, k: int, w: int) -> str:
    """Distinct (id, minimizer) of pure ACGT sequences."""
    mask = f"{1 << (2 * k)}::uhugeint"
    code = lambda i: f"(instr('ACGT', substr(kmer, {i}, 1)) - 1)::uhugeint"
    forward = " + ".join(f"{code(i)} * {4 ** (k - i)}::uhugeint" for i in range(1, k + 1))
    backward = " + ".join(f"(3::uhugeint - {code(i)}) * {4 ** (i - 1)}::uhugeint" for i in range(1, k + 1))
    sx = lambda by: f"xor(x::ubigint, (x // {1 << by}::uhugeint)::ubigint)::uhugeint"
    return f"""with recursive {seqs}, {kmers(k)},
packed as (select kmer, {forward} as f, {backward} as b from (select distinct kmer from kmers)),
h0 as (select kmer, f, b, (least(f, b) * {(1 << 21) - 1}::uhugeint + {mask} - 1) % {mask} as x from packed),
h1 as (select kmer, f, b, {sx(24)} * 265 % {mask} as x from h0),
h2 as (select kmer, f, b, {sx(14)} * 21 % {mask} as x from h1),
h3 as (select kmer, f, b, {sx(28)} * {(1 << 31) + 1}::uhugeint % {mask} as x from h2),
placed as (select id, pos + {k - 2} as spot, case when f <> b then case when pos + {k - 2} - {w} + 2 < 0 then {(1 << 64) - 1}::uhugeint else x * 256 + least(pos + {k - 2} - {w} + 2, {k})::uhugeint end end as v, f <> b as valid from kmers join h3 using (kmer) join seqs using (id) where length(seq) >= {w + k - 1}),
mins as (select id, spot, valid, min(v) over (partition by id order by spot range between {w - 1} preceding and current row) as v from placed)"""


MINIMIZERS = " select distinct id, " + SIGNED.format("v") + " as minimizer from mins where valid and spot >= {0}"


def integer_hash32(x: str, steps: list[tuple[str, int]]) -> list[str]:
    """Select lists in turn for 32-bit mixers of column x: xor with a shift, or multiply."""
    out = []
    for kind, by in steps:
        out.append(f"xor({x}, {x} // {1 << by}::ubigint)" if kind == "shift" else f"({x} * {by}::ubigint) % 4294967296::ubigint")
    return out


FMIX32_STEPS = [("shift", 16), ("times", hashing.FMIX32[0]), ("shift", 13), ("times", hashing.FMIX32[1]), ("shift", 16)]


def mixed32(prefix: str, source: str, keep: str, steps: list[tuple[str, int]] = FMIX32_STEPS) -> str:
    """CTEs over column x of source; the last is prefix and the number of steps."""
    parts = []
    for n, expression in enumerate(integer_hash32("x", steps)):
        parts.append(f"{prefix}{n + 1} as (select {keep}, {expression} as x from {source if n == 0 else f'{prefix}{n}'})")
    return ", ".join(parts)


def jump(name: str, source: str, buckets: int) -> str:
    """CTEs that end in name(k, bucket): the jump consistent hash of the 64-bit numbers k of source, a step of all at a time."""
    return f"""{name}_r(k, s, b, nxt) as (
  select k, k, 0::bigint, 0::bigint from (select distinct k from {source})
  union all select k, s, nxt, trunc((nxt + 1) * (2147483648::double / ((s // 8589934592::uhugeint) + 1)::double))::bigint
  from (select k, nxt, (s * {hashing.JUMP_MULTIPLIER}::uhugeint + 1) % {M64} as s from {name}_r where nxt < {buckets})
), {name} as (select k, max(b) as bucket from {name}_r group by k)"""


def spectrum(seqs: str, k: int, w: int) -> str:
    """CTEs that end in spec(id, bin, freq): each row's distinct minimizers count once, rows of an id add up."""
    numbered = seqs.replace("as id,", "as src, row_number() over () as id,", 1)
    return (
        minimizers(numbered, k, w)
        + f""", found as (select distinct id, v as k from mins where valid and spot >= {w - 1}), {jump("bins", "found", k**4)},
spec as (select src as id, bucket as bin, count(*)::double as freq from found join bins using (k) join seqs using (id) group by src, bucket)"""
    )


def count_min() -> str:
    """CTEs that end in est(id, bin, freq, estimate) over spec."""
    from sketchloom.operators.weighted import CELLS, ROWS

    return f"""rows as (select unnest(range({ROWS})) as i), asked as (select bin, i, (bin * (1 + i))::uhugeint as k from (select distinct bin from spec), rows), {jump("cells", "asked", CELLS)},
placed_bins as (select id, bin, freq, i, bucket from spec join asked using (bin) join cells using (k)),
so_far as (select id, bin, freq, sum(freq) over (partition by id, i, bucket order by bin rows unbounded preceding) as total from placed_bins),
est as (select id, bin, any_value(freq) as freq, min(total) as estimate from so_far group by id, bin)"""


def weighted_sketch(size: int, seed: int) -> str:
    """CTEs that end in wm(id, slot, bin, weight) over est."""
    from sketchloom.operators.weighted import GOLDEN32

    return f"""seeded as (select bin, xor(bin::ubigint, {seed}::ubigint) as x from (select distinct bin from est)), {mixed32("wa", "seeded", "bin")},
counters as (select unnest(range({size * 5})) as i), counted as (select bin, i, (x + i::ubigint * {GOLDEN32}::ubigint) % 4294967296::ubigint as x from wa5, counters), {mixed32("wb", "counted", "bin, i")},
unis as (select bin, (i // 5)::int as slot, max(u) filter (i % 5 = 0) as u0, max(u) filter (i % 5 = 1) as u1, max(u) filter (i % 5 = 2) as u2, max(u) filter (i % 5 = 3) as u3, max(u) filter (i % 5 = 4) as u4
  from (select bin, i, (x::double + 0.5) / 4294967296 as u from wb5) group by bin, i // 5),
tabs as (select bin, slot, -ln(u0) - ln(u1) as r, ln(-ln(u2) - ln(u3)) as c, u4 * (-ln(u0) - ln(u1)) as b from unis),
drawn as (select id, slot, bin, c / (exp(ln(estimate) - c * b) * exp(r)) as a from est join tabs using (bin)),
wm as (select id, slot, bin, a as weight from drawn qualify row_number() over (partition by id, slot order by a, bin) = 1)"""


def weighted_pairs() -> str:
    """CTE wj(i, j, weighted_jaccard) of all pairs of ids in wm."""
    return """wj as (select a.id as i, b.id as j, sum(case when a.bin = b.bin then least(abs(a.weight), abs(b.weight)) else 0 end) / sum(greatest(abs(a.weight), abs(b.weight))) as weighted_jaccard
  from wm a join wm b using (slot) where a.id < b.id group by a.id, b.id)"""


def counts_list(top: int, m: int) -> str:
    """Aggregate over rank and n: registers by rank, from 0 to top."""
    seen = ", ".join(f"coalesce(sum(n) filter (rank = {r}), 0)::double" for r in range(1, top + 1))
    return f"list_concat([({m} - coalesce(sum(n) filter (rank > 0), 0))::double], [{seen}])"


def likely(name: str, source: str, keys: str, m: int) -> str:
    """CTEs that end in name(keys, x): the root of the likelihood's derivative for lists c of source, by bisection."""
    from sketchloom.operators.hll import BISECTIONS
    from math import log2

    y = "least(700.0, pow(2.0, mid) * pow(2.0, -least(r, t - 1)))"
    rising = f"list_sum(list_transform(range(1, t + 1), lambda r: c[r + 1] * ({y} / (2 * exp({y} / 2) * sinh({y} / 2))))) > pow(2.0, mid) * lin"
    return f"""{name}_c as (select {keys}, c, len(c) - 1 as t, list_sum(list_transform(range(0, len(c) - 1), lambda r: c[r + 1] * pow(2.0, -r))) as lin from {source}),
{name}_b as (
  select {keys}, c, t, lin, 0 as it, {-log2(m) - 2!r}::double as lo, (t + 2 + {log2(m)!r})::double as hi from {name}_c
  union all select {keys}, c, t, lin, it + 1, case when up then mid else lo end, case when up then hi else mid end
  from (select *, {rising} as up from (select *, (lo + hi) / 2 as mid from {name}_b where it < {BISECTIONS}))
), {name} as (select {keys}, case when c[1] = {m} then 0.0 else {m} * pow(2.0, (lo + hi) / 2) end as x from {name}_b where it = {BISECTIONS})"""


def improved(m: int) -> str:
    """Expression over a list c: the improved estimate."""
    from sketchloom.operators.hll import TERMS

    x, y = f"(c[1] / {m})", f"(1 - c[len(c)] / {m})"
    small = f"({x} + list_sum(list_transform(range(1, {TERMS}), lambda k: pow({x}, pow(2.0, k)) * pow(2.0, k - 1))))"
    large = f"(case when {y} > 0 then (1 - {y} - list_sum(list_transform(range(1, {TERMS}), lambda k: pow(1 - pow({y}, pow(2.0, -k)), 2) * pow(2.0, -k)))) / 3 else 0 end)"
    middle = "list_sum(list_transform(range(1, len(c) - 1), lambda r: c[r + 1] * pow(2.0, -r)))"
    return f"({float(m) * m!r} / (2 * ln(2) * ({m} * {small} + {middle} + {m} * {large} * pow(2.0, -(len(c) - 2)))))"


def pair_kinds(p: int, halves: bool) -> str:
    """CTE kinds(i, j, kind, c) over the register pairs of `joint`; halves: with the two unions that have a side a step lower."""
    m, top = 1 << p, 64 - p + 1
    parts = ["select i, j, 'a' as kind, x as rank from joined", "select i, j, 'b', y from joined", "select i, j, 'whole', greatest(x, y) from joined"]
    lists = [f"select i, j, kind, {counts_list(top, m)} as c from ranks where kind in ('a', 'b', 'whole') group by i, j, kind"]
    if halves:
        parts += [f"select i, j, 'half_b', least({top - 1}, greatest(x, y - 1)) from joined", f"select i, j, 'half_a', least({top - 1}, greatest(x - 1, y)) from joined"]
        lists.append(f"select i, j, kind, {counts_list(top - 1, m)} as c from ranks where kind like 'half%' group by i, j, kind")
    return f"""ranks as (select i, j, kind, rank, count(*) as n from ({" union all ".join(parts)}) group by i, j, kind, rank),
kinds as ({" union all ".join(lists)})"""


def joint_jaccard(p: int) -> str:
    """CTEs that end in hj(i, j, only_i, only_j, both_, jaccard) over regs."""
    return f"""{joint(p)}, {pair_kinds(p, True)}, {likely("sizes", "kinds", "i, j, kind", 1 << p)},
wide as (select i, j, max(x) filter (kind = 'a') as a, max(x) filter (kind = 'b') as b, max(x) filter (kind = 'whole') as u, max(x) filter (kind like 'half%') as h1, min(x) filter (kind like 'half%') as h2 from sizes group by i, j),
split as (select i, j, greatest(0, u - b) as only_i, greatest(0, u - a) as only_j, greatest(0, (1.5 * (a + b) + h1 + h2 - 3 * u) / 2) as both_ from wide),
hj as (select *, case when only_i + only_j + both_ > 0 then both_ / (only_i + only_j + both_) end as jaccard from split)"""


def order_blocks(k: int, m: int, seed: int, seqs: str = SEQS) -> str:
    """CTEs that end in blocks(id, block, kmers) for l = 2, and in lists of them by id, omh(id, kms), where kms holds the two k-mers of each block."""
    seeds = ", ".join(f"({i}, {int(s)}::uhugeint)" for i, s in enumerate(hashing.mersenne64(seed, m)))
    code = lambda i: f"(instr('ACTG', substr(kmer, {i}, 1)) - 1)::uhugeint"
    packed = " + ".join(f"{code(i)} * {4 ** (k - i + 1)}::uhugeint" for i in range(1, k + 1))
    steps = fmix_steps("of", "mixed", "x", "id, pos, kmer, block")
    return f"""with {seqs}, {kmers(k)},
coded as (select id, pos, kmer, {packed} + (row_number() over (partition by id, kmer order by pos) - 1)::uhugeint as x from kmers),
seeds(block, s) as (values {seeds}),
mixed as (select id, pos, kmer, block, {_xor('x', 's')} as x from coded, seeds),
{", ".join(steps)},
ranked as (select *, row_number() over (partition by id, block order by x, pos) as r from of3),
blocks as (select id, block, string_agg(kmer, '' order by pos) as kmers from ranked where r <= 2 group by id, block having count(*) = 2)"""


def murmur32(k: int, seed: int = 42) -> str:
    """CTEs that end in h32(kmer, x): the 32-bit hash of the distinct k-mers of canon."""
    c1, c2, add = hashing.MURMUR32
    word = lambda lo, hi: " + ".join(f"ord(substr(kmer, {i + 1}, 1))::ubigint * {1 << (8 * (i - lo))}::ubigint" for i in range(lo, hi))
    times = lambda a, b: f"(({a}) * {b}::ubigint % 4294967296::ubigint)"
    turned = lambda a, by: f"((({a}) * {1 << by}::ubigint % 4294967296::ubigint) + ({a}) // {1 << (32 - by)}::ubigint)"
    steps = [f"q0 as (select kmer, {seed}::ubigint as x from (select distinct kmer from canon))"]
    for at in range(0, k - k % 4, 4):
        n = len(steps)
        steps.append(f"w{n} as (select kmer, x, {times(word(at, at + 4), c1)} as y from q{n - 1})")
        steps[-1] += f", v{n} as (select kmer, xor(x, {times(turned('y', 15), c2)}) as x from w{n})"
        steps[-1] += f", q{n} as (select kmer, ({turned('x', 13)} * 5 + {add}::ubigint) % 4294967296::ubigint as x from v{n})"
    last = f"q{len(steps) - 1}"
    tail = f"xor(x, {times(turned(times(word(k - k % 4, k), c1), 15), c2)})" if k % 4 else "x"
    return ", ".join(steps) + f", tailed as (select kmer, xor({tail}, {k}::ubigint) as x from {last}), " + mixed32("hx", "tailed", "kmer") + ", h32 as (select kmer, x from hx5)"
