"""Secret scans: named patterns, and a battery of randomness tests, with DataFrame functions alone.

Opaque runs of signs are tested against the alphabet of the encoding they seem to be in: chi-squared uniformity,
Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial correlation; the smallest of the three
p-values counts, times three. Within each encoding and length class the Benjamini-Hochberg rule rejects
randomness; what is not rejected is taken for a secret. Rejection counts are kept on a fixed grid of p-values,
so what reaches the driver is bounded whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from designmat.llm.common import free, named, table

# The base patterns, with their shortest length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "random"]
_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (name, pattern, alphabet), the first that fits is taken.
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", _DIGIT + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGIT + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UP + "234567"),
    ("base36", "^[a-z0-9]+$", _LOW + _DIGIT),
    ("BASE36", "^[A-Z0-9]+$", _UP + _DIGIT),
    ("base62", "^[A-Za-z0-9]+$", _UP + _LOW + _DIGIT),
    ("base64", "^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGIT + "+/"),
    ("base64url", "", _UP + _LOW + _DIGIT + "-_"),
]
GRID, FINEST = 20, 400
BLOCK = 512


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def _blocks(xs: Column) -> Column:
    """Numbers of the blocks of a bound array, none for an empty one."""
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _scan(xs: Column, zero: Column, kind: str, step) -> Column:
    """The outputs of step(state, x) -> (state, output) along xs. Outputs are appended within blocks and blocks to
    each other, so that a text with very many matches isn't copied whole for each."""
    none = lambda of: F.array().cast(f"array<{of}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def run(all_: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(all_, i * BLOCK + 1, BLOCK), F.struct(acc["state"].alias("state"), none(kind).alias("out")), one)
            return _let(done, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

        return F.flatten(F.aggregate(_blocks(all_), F.struct(zero.alias("state"), none(f"array<{kind}>").alias("out")), block)["out"])

    return _let(xs, run)


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """All matches as (start, kind, end, value), code points, end exclusive; group 2 of assign has a least length."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else hits
    between = F.split(text, pattern, -1)
    fields = "struct<start:int,kind:int,end:int,value:string>"
    all_ = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return end, F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))

    found = _scan(all_, F.lit(0), fields, step)
    found = F.filter(found, lambda x: F.length(x["value"]) >= least) if least else found
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{fields}>"))


def _apart(base: Column, more: Column) -> Column:
    """The spans of more that overlap none of base: along the starts with the furthest end so far, then back with the
    nearest start."""
    fields = "struct<start:int,kind:int,end:int,bad:boolean>"
    span = lambda x, bad: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), bad.alias("bad"))
    own = lambda x: x["kind"] == KINDS.index("random")
    merged = F.array_sort(F.transform(F.concat(base, more), lambda x: span(x, F.lit(False))))
    ahead = _scan(merged, F.lit(0), fields, lambda far, x: (F.when(own(x), far).otherwise(F.greatest(far, x["end"])), span(x, own(x) & (far > x["start"]))))
    back = _scan(F.reverse(ahead), F.lit(2**31 - 1), fields, lambda near, x: (F.when(own(x), near).otherwise(F.least(near, x["start"])), span(x, x["bad"] | (near < x["end"]))))
    return F.transform(F.filter(back, lambda x: own(x) & ~x["bad"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution at |z|: Abramowitz and Stegun 7.1.26."""

    def at(x: Column) -> Column:
        poly = lambda t: reduce(lambda acc, c: (acc + c) * t, [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(0.0))
        return F.lit(0.5) * _let(1 / (1 + F.lit(0.3275911) * x), poly) * F.exp(-x * x)

    return _let(F.abs(z) / F.lit(2.0**0.5), at)


def battery(value: Column) -> Column:
    """(stratum, p) of one opaque string: p is small where it does not look uniformly random."""
    kind = F.struct(F.lit(ENCODINGS[-1][0]).alias("name"), F.lit(ENCODINGS[-1][2]).alias("letters"))
    for name, pattern, letters in reversed(ENCODINGS[:-1]):
        kind = F.when(value.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(letters).alias("letters"))).otherwise(kind)
    signs = F.filter(F.split(value, ""), lambda c: c != "")

    def tests(e: Column) -> Column:
        n, k, at = F.size(e["at"]).cast("double"), F.length(e["letters"]).cast("double"), e["at"]
        half, df = k / 2, k - 1
        chi = F.aggregate(e["distinct"], F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(value, c, F.lit(""))), F.lit(2.0))) * k / n - n
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2 / 9) / df)) / F.sqrt(F.lit(2 / 9) / df)
        p_chi = _let(z, lambda z: F.when(z > 0, _tail(z)).otherwise(1 - _tail(z)))

        def follow(f) -> Column:  # one pass over neighbours
            return F.aggregate(at, F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("sum")), lambda acc, v: F.struct(
                v.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + f(acc["last"], v)).alias("sum")))["sum"]

        total = lambda f: F.aggregate(at, F.lit(0.0), lambda acc, v: acc + f(v))
        switches = follow(lambda a, b: F.when((a > half) != (b > half), 1.0).otherwise(0.0))

        def runs(high: Column) -> Column:
            mean = 2 * high * (n - high) / n + 1
            return _let(mean, lambda m: _let((m - 1) * (m - 2) / (n - 1), lambda var: F.when(var > 0, 2 * _tail((1 + switches - m) / F.sqrt(var))).otherwise(0.0)))

        def serial(centre: Column) -> Column:
            spread = total(lambda v: (v - centre) * (v - centre))
            r = follow(lambda a, b: (a - centre) * (b - centre))
            return _let(spread, lambda s: F.when(s > 0, 2 * _tail(r / s * F.sqrt(n))).otherwise(0.0))

        p_runs = _let(total(lambda v: F.when(v > half, 1.0).otherwise(0.0)), runs)
        p_serial = _let(total(lambda v: v) / n, serial)
        size = F.when(n < 32, "24").when(n < 64, "32").when(n < 256, "64").otherwise("256")
        return F.struct(F.concat(e["name"], F.lit(":"), size).alias("stratum"), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("p"))

    def spelt(e: Column) -> Column:
        at = F.transform(signs, lambda c: F.instr(e["letters"], c).cast("double"))
        return _let(F.struct(e["name"].alias("name"), e["letters"].alias("letters"), at.alias("at"), F.array_distinct(signs).alias("distinct")), tests)

    return _let(kind, spelt)


def _tested(text: Column) -> Column:
    """Opaque strings with letters and digits, with their test results."""
    mixed = F.filter(_spans(text, OPAQUE, "random"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return F.transform(mixed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), battery(s["value"]).alias("test")))


def thresholds(texts: DataFrame, rate: float = 0.05) -> dict[str, float]:
    """Largest rejected p by stratum over all texts (column t): at most one number for each of 32 strata."""
    each = texts.where(F.col("t").rlike(OPAQUE)).select(F.explode(_tested(F.col("t"))["test"]).alias("x"))
    level = F.least(F.lit(FINEST), F.floor(-F.log10(F.greatest("x.p", F.lit(1e-20))) * GRID)).cast("int")
    counts = each.groupBy(F.col("x.stratum").alias("stratum"), level.alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")
    p = F.pow(F.lit(10.0), -F.col("level") / GRID)  # the largest p of the level
    ranked = counts.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("level")))).withColumn("all", F.sum("n").over(w))
    kept = ranked.where(p <= rate * F.col("rank") / F.col("all")).groupBy("stratum").agg(F.min("level").alias("level"))
    return {r["stratum"]: 10.0 ** (-r["level"] / GRID) for r in kept.collect()}


def _scanned(docs: DataFrame, base: str, found: str, rate: float) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    limit = thresholds(docs.select(t.alias("t")), rate)
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    access = F.when(F.contains(t, F.lit("AKIA")), bare(_spans(t, ACCESS, "access"))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    firm = F.array_sort(F.concat(bare(_spans(t, ASSIGN, "assign", 6)), access, bare(_spans(t, HEX, "hex"))))
    bound = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]) if limit else None
    ok = lambda s: s["test"]["p"] > (F.coalesce(F.try_element_at(bound, s["test"]["stratum"]), F.lit(-1.0)) if limit else -1.0)
    more = F.filter(_tested(t), ok)
    more = F.when(t.rlike(OPAQUE), _apart(F.col(base), bare(more))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return docs.withColumn(base, firm).withColumn(found, F.array_sort(F.concat(base, more)))


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """All columns of docs and ``base`` and ``found``: sorted arrays of (start, kind, end), kind an index of KINDS.

    Null texts count as empty and have no spans. Added spans are those that overlap no base span. Rows are only
    mapped; repeated rows, null ids and extra columns pass through. Where docs have columns named base or found
    the new ones have an underscore before their names (as many as it takes).
    """
    return _scanned(docs, *free(docs.columns, "base", "found"), rate)


def said(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs.select("doc_id", "text")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("found").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same columns with every span replaced by a mark; n_chars, where there is one, follows the new text.

    Null and empty texts stay as they are; every row stays, repeated ones too; columns may have any names.
    """
    base, found = free(docs.columns, "base", "found")
    done = _scanned(docs, base, found, 0.05)
    t = F.coalesce("text", F.lit(""))

    gap = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    gaps = _scan(F.col(found), F.lit(0), "struct<lo:int,hi:int>", lambda at, x: (F.greatest(at, x["end"]), gap(at, x["start"])))
    last = gap(F.array_max(F.transform(found, lambda x: x["end"])), F.length(t))
    kept = F.array_append(F.filter(gaps, lambda g: g["lo"] <= g["hi"]), last)  # overlapping spans are one

    def written(all_: Column) -> Column:
        def block(i: Column) -> Column:
            def pieces(b: Column) -> Column:
                lo = b[0]["lo"]
                part = F.substring(t, lo + 1, F.element_at(b, -1)["hi"] - lo)
                return _let(part, lambda v: F.array_join(F.transform(b, lambda g: F.substring(v, g["lo"] - lo + 1, g["hi"] - g["lo"])), mark))

            return _let(F.slice(all_, i * BLOCK + 1, BLOCK), pieces)

        return F.array_join(F.transform(_blocks(all_), block), mark)

    text = F.when(F.size(found) > 0, _let(kept, written)).otherwise(F.col("text"))
    out = done.withColumn("text", text).drop(base, found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[named(c) for c in docs.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL of the report; its patterns know no lookbehind, which a greedy run from its first sign makes needless."""
    word = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    patterns = [ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", f"({word})"), ACCESS, HEX, OPAQUE.partition(")")[2]]

    def spans(kind: int, least: int = 0) -> str:
        at = quoted(patterns[kind])
        value = f"regexp_extract_all(t, {at}, 2)" if least else "h"
        return f"""select rid, {kind} as kind, e - length(h) as s, e, v from (
            select rid, h, v, sum(length(g) + length(h)) over (partition by rid order by i) as e from (
              select rid, unnest(h) as h, unnest(g[1:len(h)]) as g, unnest({value}) as v, unnest(range(len(h))) as i
              from (select rid, t, regexp_extract_all(t, {at}) as h, string_split_regex(t, {at}) as g from d where regexp_matches(t, {at}))))
            where length(v) >= {least}"""

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.3275911::double * (abs({z}) / sqrt(2::double))))"
        poly = reduce(lambda acc, c: f"(({acc} + ({c})::double) * {t})", ["1.061405429", "-1.453152027", "1.421413741", "-0.284496736", "0.254829592"], "0")
        return f"(0.5::double * {poly} * exp(-(abs({z}) / sqrt(2::double)) * (abs({z}) / sqrt(2::double))))"

    fits = " ".join(f"when regexp_matches(v, {quoted(pattern)}) then " + "{}" for _, pattern, _ in ENCODINGS[:-1])
    pick = lambda k: "case " + fits.format(*(f"'{e[k]}'" for e in ENCODINGS[:-1])) + f" else '{ENCODINGS[-1][k]}' end"
    count = lambda k: f"coalesce(len(list_filter(base, lambda x: x.kind = {k})), 0)::bigint as n_{KINDS[k]}"
    said = lambda x: f"coalesce(array_to_string(list_transform(list_sort({x}), lambda x: {KINDS}[x.kind + 1] || ':' || x.s || ':' || x.e), ','), '')"
    one = "struct_pack(s := s::bigint, kind := kind, e := e::bigint)"
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    base as ({spans(0, 6)} union all {spans(1)} union all {spans(2)}),
    opaque as (select rid, kind, s, e, v, row_number() over () as vid, {pick(0)} as name, {pick(2)} as letters
      from ({spans(3)}) where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')),
    signs as (select vid, unnest(string_split(v, '')) as c, unnest(range(length(v))) as i, letters from opaque),
    places as (select vid, i, c, strpos(letters, c)::double as p, length(letters)::double as k from signs),
    sums as (select vid, count(*)::double as n, max(k) as k, sum(p) / count(*) as centre, sum(case when p > k / 2 then 1.0::double else 0 end) as high from places group by vid),
    squares as (select vid, sum(m * m)::double as sq from (select vid, c, count(*) as m from places group by vid, c) group by vid),
    steps as (select vid, i, p, k, lag(p) over (partition by vid order by i) as last from places),
    moves as (select vid, sum(case when (p > x.k / 2) <> (last > x.k / 2) then 1.0::double else 0 end) as switches,
      sum((last - centre) * (p - centre)) as r, sum((p - centre) * (p - centre)) as spread from steps x join sums using (vid) group by vid),
    stats as (select vid, n, r, spread, switches, 2 * high * (n - high) / n + 1 as m, greatest(sq * k / n - n, 0) as chi, k - 1 as df
      from sums join squares using (vid) join moves using (vid)),
    scores as (select vid, n, (m - 1) * (m - 2) / (n - 1) as var, m, switches, spread,
      (pow(chi / df, 1 / 3::double) - (1 - 2 / 9::double / df)) / sqrt(2 / 9::double / df) as zc,
      case when spread > 0 then r / spread * sqrt(n) else 0 end as zs from stats),
    zs as (select *, case when var > 0 then (1 + switches - m) / sqrt(var) else 0 end as zr from scores),
    ps as (select vid, n, case when zc > 0 then {tail("zc")} else 1 - {tail("zc")} end as a,
      case when var > 0 then 2 * {tail("zr")} else 0 end as b, case when spread > 0 then 2 * {tail("zs")} else 0 end as c from zs),
    tested as (select rid, kind, s, e, least(1, 3 * least(a, b, c)) as p,
      name || ':' || case when n < 32 then '24' when n < 64 then '32' when n < 256 then '64' else '256' end as stratum from ps join opaque using (vid)),
    levels as (select stratum, least({FINEST}, floor(-log10(greatest(p, 1e-20::double)) * {GRID}))::int as level, count(*) as n from tested group by 1, 2),
    ranked as (select stratum, level, sum(n) over (partition by stratum order by level desc) as rank, sum(n) over (partition by stratum) as total from levels),
    bounds as (select stratum, pow(10::double, -min(level) / {GRID}::double) as top from ranked
      where pow(10::double, -level / {GRID}::double) <= 0.05::double * rank / total group by stratum),
    more as (select rid, kind, s, e from tested left join bounds using (stratum) where p > coalesce(top, -1)
      and not exists (select 1 from base where base.rid = tested.rid and base.s < tested.e and tested.s < base.e)),
    by_base as (select rid, list({one}) as base from base group by rid),
    by_all as (select rid, list({one}) as found from (select rid, kind, s, e from base union all from more) group by rid)
    select doc_id, {count(0)}, {count(1)}, {count(2)}, sha256({said("base")}) as base_sha256, {said("found")} as spans
    from d left join by_base using (rid) left join by_all using (rid)"""


#: Holds for the query's own rate of 0.05.
ORACLE_SQL = _oracle()
