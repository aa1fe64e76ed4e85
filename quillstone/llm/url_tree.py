"""URL filter: host rules first, then a path-template tree learned per host.

Paths of a host form a tree of segments.  Level by level, segment values that
too few of their siblings' pages have become the wildcard ``*``, unless they are
common over all hosts.  Sibling branches whose labelled block rates cannot be
told apart merge into ``~``.  A template is rejected if its labelled purity,
smoothed, reaches a threshold.  The labels are the verdicts of the rules.

A node is smoothed by its parent in the host's tree, moved by how the same path
over all hosts differs from its own parent there; the chain starts at the
overall rate.  So a template without a label has the evidence of its host and
that of its path on other hosts.

All of it is DataFrame operations.  Pages collapse to distinct paths of a host
first; a value stays literal only with a fixed share of its parent's pages, in
the host or over all hosts, so a node has a bounded number of literal children
however large the host is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import HOT, joined, materialize, small

#: (host, path, verdict); a rule fits its host, all subdomains and any path
#: that starts with its own.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LEVELS = 4  # segments that are told apart; what lies deeper is one wildcard
SHARE = 0.02  # of its parent's pages that a literal segment has at least
SUPPORT = 3  # pages that a literal segment has at least
APART = 1.96  # standard errors from which on branches differ
PRIOR = 4.0  # labelled pages that what a node is smoothed by counts for
LEAST_RATE = 1e-6  # nearest that a rate comes to 0 and 1 where odds are taken
REJECT = 0.6  # smoothed purity from which on a template is rejected

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://``, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _longest_first(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))


def _first_fit(rules: list, host: Column, path: Column, value) -> Column:
    found = F.lit(None).cast("string")
    for h, p, verdict in reversed(_longest_first(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(value(h, p, verdict))).otherwise(found)
    return found


def _literal(paths: DataFrame, parents: list[str], segment: str, share: float, support: int, total: int) -> DataFrame:
    """The parents and segments that stay literal, and their pages ``_n``."""
    children = materialize(paths.groupBy(*parents, segment).agg(F.sum("pages").alias("_n")), "children")
    # every parent has at most 1 / share such children
    common = (F.col("_n") >= support) & (F.col("_n") >= F.col("_all") * share)
    often = children.filter(F.col("_n") >= support)
    if parents:
        totals = materialize(children.groupBy(*parents).agg(F.sum("_n").alias("_all")), "totals")
        often = joined(often, totals, parents, F.col("_all") * HOT >= total)
    else:
        often = often.withColumn("_all", F.lit(total))
    return materialize(often.filter(common).select(*parents, segment, "_n", F.lit(True).alias("_keep")), "literal")


def _odds(rate: Column) -> Column:
    held = F.least(F.greatest(rate, F.lit(LEAST_RATE)), F.lit(1 - LEAST_RATE))
    return held / (1 - held)


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    share: float = SHARE,
    support: int = SUPPORT,
    prior: float = PRIOR,
    reject: float = REJECT,
    levels: int = LEVELS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each page.

    ``pages`` needs ``page_id`` and ``url``; other columns are not read.  A
    null url, or one without ``://``, has an empty host and path and is judged
    like the pages of any host.  ``rule`` is the longest that fits, of equally
    long ones the first by code point.  ``levels`` segments are told apart, all
    below is one wildcard.  Repeated rows count each; without any labelled page
    nothing is rejected; an empty table gives an empty result.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.select(
        "*",
        _first_fit(rules, host, path, lambda h, p, v: h + p).alias("rule"),
        _first_fit(rules, host, path, lambda h, p, v: v).alias("ruled"),
        F.split(F.regexp_replace(path, "^/", ""), "/").alias("_s"),
    )
    ks = range(1, levels + 1)
    named = [F.coalesce(F.get("_s", i), F.lit("")).alias(f"s{i + 1}") for i in range(levels - 1)]
    last = F.coalesce(F.get("_s", levels - 1), F.lit(""))
    named.append(F.when(F.size("_s") > levels, F.concat(last, F.lit("/**"))).otherwise(last).alias(f"s{levels}"))
    rows = materialize(rows.select("page_id", "host", "path", "rule", "ruled", *named), "urls")
    total = rows.count()
    place = ["host", *[f"s{k}" for k in ks]]
    labelled = F.count("ruled").alias("n")
    blocked = F.count(F.when(F.col("ruled") == "block", 1)).alias("b")
    paths = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("pages"), labelled, blocked)
    paths = materialize(paths, "paths")

    # over all hosts (g), then in each (t)
    for top, name in (([], "g"), (["host"], "t")):
        parents = list(top)
        for k in ks:
            s = f"s{k}"
            kept = _literal(paths, parents, s, share, support, total)
            paths = joined(paths, kept, [*parents, s], F.col("_n") * HOT >= total, "left")
            literal = F.col("_keep") | (F.col(s) == "")
            if name == "t":
                literal = literal | (F.col(f"g{k}") == F.col(s))
            paths = materialize(paths.withColumn(f"{name}{k}", F.when(literal, F.col(s)).otherwise("*")).drop("_keep", "_n"), f"level{name}{k}")
            parents = [*parents, f"{name}{k}"]

    # a template of a host lies in one template over all hosts
    ts, gs = [f"t{k}" for k in ks], [f"g{k}" for k in ks]
    tree = materialize(paths.groupBy("host", *ts, *gs).agg(*[F.sum(c).alias(c) for c in ("pages", "n", "b")]), "tree")
    every = materialize(tree.groupBy(*gs).agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "every")  # of bounded size
    sums = every.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    rate = sums["b"] / sums["n"] if sums["n"] else 0.0
    every = every.withColumn("z0", F.lit(rate))
    for k in ks:
        over = Window.partitionBy(*gs[:k])
        every = every.withColumn(f"z{k}", (F.sum("b").over(over) + prior * F.col(f"z{k - 1}")) / (F.sum("n").over(over) + prior))
    every = materialize(every.drop("n", "b"), "rates")
    tree = tree.join(small(every), gs).withColumn("rate", F.lit(rate))
    for k in [0, *ks]:
        over = Window.partitionBy("host", *ts[:k])
        tree = tree.withColumns({f"_n{k}": F.sum("n").over(over), f"_b{k}": F.sum("b").over(over)})
        if k:
            odds = _odds(F.col("rate")) * _odds(F.col(f"z{k}")) / _odds(F.col(f"z{k - 1}"))
            tree = tree.withColumn("prior", odds / (1 + odds))
        else:
            tree = tree.withColumn("prior", F.col("rate"))
        tree = tree.withColumn("rate", (F.col(f"_b{k}") + prior * F.col("prior")) / (F.col(f"_n{k}") + prior))
    for k in ks:
        own, up = F.try_divide(f"_b{k}", f"_n{k}"), F.try_divide(f"_b{k - 1}", f"_n{k - 1}")
        error = F.sqrt(F.try_divide(up * (1 - up), F.col(f"_n{k}")))
        alike = (F.col(f"_n{k}") > 0) & (F.col(f"_n{k}") < F.col(f"_n{k - 1}")) & (F.abs(own - up) <= APART * error)
        tree = tree.withColumn(f"m{k}", F.when(alike, F.lit("~")).otherwise(F.col(f"t{k}")))
    ms = [f"m{k}" for k in ks]
    # in whole billionths, so that no order of adding matters
    tree = tree.withColumn("share", F.round(F.col("prior") * 1e9).cast("long").cast("decimal(38,0)") * F.col("pages"))
    tree = materialize(tree.select("host", *ts, *ms, "pages", "n", "b", "share"), "merged")
    pools = tree.groupBy("host", *ms).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("share").alias("share"))
    mean = F.col("share").cast("double") / F.col("pages") / 1e9
    template = F.concat(*[x for k in ks for x in (F.lit("/"), F.col(f"m{k}"))])
    purity = F.round((F.col("b") + mean * prior) / (F.col("n") + prior), 6).alias("purity")
    verdicts = tree.select("host", *ts, *ms).join(pools.select("host", *ms, template.alias("template"), purity), ["host", *ms]).drop(*ms)
    verdicts = materialize(verdicts, "verdicts")
    weights = paths.groupBy("host", *ts).agg(F.sum("pages").alias("_n"))
    verdicts = materialize(verdicts.join(weights, ["host", *ts]), "weighed")
    known = joined(paths.select(*place, *ts, "pages"), verdicts, ["host", *ts], F.col("_n") * HOT >= total).select(*place, "pages", "template", "purity")
    out = joined(rows, materialize(known, "known"), place, F.col("pages") * HOT >= total)
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def oracle(
    rules: list[tuple[str, str, str]] = RULES, share: float = SHARE, support: int = SUPPORT, prior: float = PRIOR, reject: float = REJECT, levels: int = LEVELS
) -> str:
    """The same in DuckDB SQL."""
    ks = range(1, levels + 1)

    def fit(value) -> str:
        whens = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in _longest_first(rules)]
        return "CASE " + " ".join(whens) + " END"

    def listed(*columns: str) -> str:
        return ", ".join(columns)

    def real(x) -> str:
        return f"CAST({x} AS DOUBLE)"

    def odds(x: str) -> str:
        held = f"least(greatest({x}, {real(LEAST_RATE)}), {real(1 - LEAST_RATE)})"
        return f"({held} / (1 - {held}))"

    seg = [f"coalesce(s[{i}], '') AS s{i}" for i in range(1, levels)]
    seg.append(f"coalesce(s[{levels}], '') || CASE WHEN len(s) > {levels} THEN '/**' ELSE '' END AS s{levels}")
    place = listed("host", *[f"s{k}" for k in ks])
    parts = [
        f"u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_SPLIT}', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '{_SPLIT}', 2), '') AS path FROM pages)",
        f"v AS (SELECT *, {fit(lambda h, p, v: h + p)} AS rule, {fit(lambda h, p, v: v)} AS ruled, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM u)",
        f"r AS (SELECT page_id, host, path, rule, ruled, {', '.join(seg)} FROM v)",
        f"g0 AS (SELECT {place}, count(*) AS pages, count(ruled) AS n, count(CASE WHEN ruled = 'block' THEN 1 END) AS b FROM r GROUP BY {place})",
    ]
    before = "g0"
    for top, name in (([], "g"), (["host"], "t")):
        up = list(top)
        for k in ks:
            s, x = f"s{k}", f"{name}{k}"
            total = f"sum(sum(pages)) OVER (PARTITION BY {listed(*up)})" if up else "sum(sum(pages)) OVER ()"
            also = f" OR p.g{k} = p.{s}" if name == "t" else ""
            parts += [
                f"c{x} AS (SELECT {listed(*up, s)}, sum(pages) AS pn, {total} AS total FROM {before} GROUP BY {listed(*up, s)})",
                f"k{x} AS (SELECT {listed(*up, s)}, TRUE AS keep FROM c{x} WHERE pn >= {support} AND pn >= {real('total')} * {real(share)})",
                f"l{x} AS (SELECT p.*, CASE WHEN keep OR p.{s} = ''{also} THEN p.{s} ELSE '*' END AS {x} FROM {before} p LEFT JOIN k{x} USING ({listed(*up, s)}))",
            ]
            before, up = f"l{x}", [*up, x]
    ts, gs, ms = ([f"{c}{k}" for k in ks] for c in "tgm")
    parts += [
        f"e AS (SELECT {listed('host', *ts, *gs)}, sum(pages) AS pages, sum(n) AS n, sum(b) AS b FROM {before} GROUP BY {listed('host', *ts, *gs)})",
        f"y0 AS (SELECT {listed(*gs)}, sum(n) AS n, sum(b) AS b, coalesce({real('sum(sum(b)) OVER ()')} / nullif({real('sum(sum(n)) OVER ()')}, 0), 0) AS z0 FROM e GROUP BY {listed(*gs)})",
    ]
    for k in ks:
        over = f"OVER (PARTITION BY {listed(*gs[:k])})"
        parts.append(f"y{k} AS (SELECT *, ({real(f'sum(b) {over}')} + {real(prior)} * z{k - 1}) / ({real(f'sum(n) {over}')} + {real(prior)}) AS z{k} FROM y{k - 1})")
    parts.append(f"h AS (SELECT e.*, {listed(*[f'z{k}' for k in [0, *ks]])}, z0 AS rate FROM e JOIN y{levels} USING ({listed(*gs)}))")
    before = "h"
    for k in [0, *ks]:
        over = f"OVER (PARTITION BY {listed('host', *ts[:k])})"
        chance = f"{odds('rate')} * {odds(f'z{k}')} / {odds(f'z{k - 1}')}" if k else ""
        held = f"SELECT * EXCLUDE (o), o / (1 + o) AS prior FROM (SELECT * {'EXCLUDE (prior)' if k else ''}, {chance} AS o FROM {before}) o{k}" if k else f"SELECT *, rate AS prior FROM {before}"
        parts += [
            f"i{k} AS (SELECT *, {real(f'sum(n) {over}')} AS n{k}, {real(f'sum(b) {over}')} AS b{k} FROM ({held}) q{k})",
            f"j{k} AS (SELECT * EXCLUDE (rate), (b{k} + {real(prior)} * prior) / (n{k} + {real(prior)}) AS rate FROM i{k})",
        ]
        before = f"j{k}"
    merged = []
    for k in ks:
        up = f"(b{k - 1} / nullif(n{k - 1}, 0))"
        merged.append(f"CASE WHEN n{k} > 0 AND n{k} < n{k - 1} AND abs(b{k} / nullif(n{k}, 0) - {up}) <= {real(APART)} * sqrt({up} * (1 - {up}) / nullif(n{k}, 0)) THEN '~' ELSE t{k} END AS m{k}")
    pooled = listed("host", *ms)
    template = " || ".join(f"'/' || m{k}" for k in ks)
    parts += [
        f"f AS (SELECT {listed('host', *ts)}, pages, n, b, {listed(*merged)}, CAST(round(prior * 1e9) AS HUGEINT) * pages AS share FROM {before})",
        f"o AS (SELECT {pooled}, {template} AS template, round(({real('sum(b)')} + {real('sum(share)')} / {real('sum(pages)')} / {real('1e9')} * {real(prior)}) / ({real('sum(n)')} + {real(prior)}), 6) AS purity FROM f GROUP BY {pooled})",
        f"w AS (SELECT {listed('host', *ts)}, template, purity FROM f JOIN o USING ({pooled}))",
        f"x AS (SELECT {place}, template, purity FROM lt{levels} JOIN w USING ({listed('host', *ts)}))",
    ]
    return (
        "WITH " + ", ".join(parts) + f" SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {real(reject)} THEN 'block' ELSE 'allow' END) AS verdict, template, purity "
        f"FROM r JOIN x USING ({place})"
    )
