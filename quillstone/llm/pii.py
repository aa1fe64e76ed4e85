"""Personal data: base patterns and boosted candidates.

Base patterns find e-mail addresses, IP addresses, cards and phone numbers.
High-recall generators then propose further, overlapping spans, among them
written-out and spaced forms and numbers that a base match ran over.  Boosted
trees judge them by their format and context; for each kind a threshold is
calibrated on documents that the trees did not learn from.

Nobody marks the spans, so the trees learn from base spans.  Features see a span
in its plain form, so how it is written out does not tell base spans apart.
Negative cases are base spans with a broken format (a missing part, a wrong
digit), base spans inside a longer word or after words that announce other
numbers, and proposals that are no valid form.  Valid proposals that touch no
base span have no label: they are what is judged.

Everything is DataFrame functions.  Spans are arrays within their document's
row: a match starts where the text before it ends, so running sums over the
pieces between the matches give all positions, and no row is split up or
shuffled.  Running sums go block by block, so that the time stays in proportion
to a text's spans.  To learn, only counts of equal feature vectors are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fresh, materialize

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = 24  # characters on each side of a span that features see
ROUNDS = 12
RATE = 0.5
LEAF = 1.0  # added to the curvature of a leaf
PRECISION = 0.9  # least share of positive cases above a threshold

# Base patterns by kind, as stated.  Possessive repeats and the looks to the
# left only forbid attempts that cannot match, so long runs take linear time;
# \G admits a match right after another.
BASE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_DOT = r"(?:\.| \. | ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?)"
# Generators: kind and pattern.
PROPOSE = [
    (0, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"),
    (1, rf"(?<![0-9.])[0-9]{{1,4}}+(?:{_DOT}[0-9]{{1,4}}+)++(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{7,24}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])"),
    (3, r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    (3, r"(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
#: A text without any of this has no span of any pattern.
HINT = r"[0-9@]|[(\[]at[)\]]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_MAIL = r"@[^@]*\.[A-Za-z]{2,12}$"
_PHONE = r"[0-9]{3}[ .-]?[0-9]{4}$"
#: Words that announce a span, and words that announce other numbers.
_GOOD_WORDS = "card|visa|tel|phone|call|mail|contact|addr|host|server"
_BAD_WORDS = r"\b(?:passw\w*|token|key|secret|hash|uuid|version|build|order|invoice|price|id|no|v|ref|isbn|sku)\W{0,4}$|[$€£]\s?$"
_SPAN = "array<struct<start:int,k:int,end:int,value:string,before:string,after:string>>"
_JUDGED = "array<struct<start:int,k:int,end:int,f:array<int>,label:int>>"
FEATURES = 11
#: Elements that one fold appends, one by one.
BLOCK = 64
#: Documents whose id's crc32 has remainder 0 calibrate; the trees see the rest.
PARTS = 4


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(xs: Column, add) -> Column:
    """The running results of ``add`` over an array of numbers, as many.

    Blocks are folded one by one from what is before them, so an array is
    copied a fixed number of times for each element.
    """

    def rest(before: Column, part: Column) -> Column:
        start = F.slice(F.transform(F.array(before), lambda x: x), 1, 1)
        grown = F.aggregate(part, start, lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(part))

    def made(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(parts, whole)

    def whole(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.aggregate(F.slice(part, 2, F.size(part)), F.get(part, F.lit(0)), add))
        zero = F.lit(0).cast("long")
        offs = F.aggregate(ends, F.array(zero), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
        return _let(offs, lambda o: F.flatten(F.transform(parts, lambda part, b: rest(F.get(o, b), part))))

    return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(_let(xs, made))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _below(ascending: Column, value: Column) -> Column:
    """How many of an ascending array of numbers are less than ``value``."""
    steps = F.array(*[F.lit(1 << b) for b in range(24, -1, -1)])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= F.size(ascending)) & (F.get(ascending, at + by - 1) < value), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _found(text: Column, kind: int, pattern: str) -> Column:
    """All matches of ``pattern`` with their code point positions and context."""

    def made(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        lengths = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long"))

        def spans(ends: Column) -> Column:
            return F.transform(
                hits,
                lambda h, i: F.struct(
                    (F.get(ends, i) - F.length(h)).cast("int").alias("start"), F.lit(kind).alias("k"), F.get(ends, i).cast("int").alias("end"), h.alias("value"),
                    F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            )

        return _let(running(lengths, _sum), spans)

    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), _let(pieces, made)).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """If the check digit is right; false for other than 12 to 19 digits."""
    n = F.length(digits)
    fits = (n >= 12) & (n <= 19)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(fits, total % 10 == 0).otherwise(F.lit(False))


def _valid(x: Column) -> Column:
    """If a base match of its kind counts."""
    n = F.length(_digits(x["value"]))
    return (
        F.when(x["k"] == 0, F.lit(True))
        .when(x["k"] == 1, x["value"].rlike(_IP))
        .when(x["k"] == 2, _luhn(_digits(x["value"])))
        .otherwise((n >= 9) & (n <= 15))
    )


def _plain(value: Column) -> Column:
    """A written-out span in its plain form."""
    at = F.regexp_replace(value, r" ?(?:@|\(at\)|\[at\]) ?", "@")
    return F.regexp_replace(at, r" ?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\]) ?| \. ", ".")


def _side(context: Column, last: bool) -> Column:
    char = F.right(context, F.lit(1)) if last else F.left(context, F.lit(1))
    return F.when(char.rlike(r"^\s?$"), 0).when(char.rlike("[A-Za-z]"), 1).when(char.rlike("[0-9]"), 2).otherwise(3)


def _context(x: Column) -> list[Column]:
    before = F.lower(x["before"])
    hint = F.when(before.rlike(_BAD_WORDS), 2).when(before.rlike(_GOOD_WORDS), 1).otherwise(0)
    return [_side(x["before"], True), _side(x["after"], False), hint]


def _features(k: Column, plain: Column, context: list[Column]) -> Column:
    """Small whole numbers on the format and the context of a span.  Digits of
    an address and dots of other than an IP address say nothing."""
    digits = _digits(plain)
    return F.array(
        k,
        F.when(k >= 2, F.least(F.length(digits), F.lit(20))).otherwise(0),
        F.when(k == 2, _luhn(digits).cast("int")).otherwise(0),
        F.when(k == 1, F.least(F.length(F.regexp_replace(plain, r"[^.]", "")), F.lit(8))).otherwise(0),
        plain.rlike(_IP).cast("int"),
        plain.rlike(_MAIL).cast("int"),
        plain.rlike(_PHONE).cast("int"),
        F.when(k == 0, F.lit(0)).otherwise(F.least(F.length(F.regexp_replace(plain, "[^A-Za-z]", "")), F.lit(3))),
        *context,
    )


def _is_valid(f: Column) -> Column:
    """If the features are those of a valid form in a plain place."""
    k = F.get(f, F.lit(0))
    form = (
        F.when(k == 0, F.get(f, F.lit(5)) == 1).when(k == 1, F.get(f, F.lit(4)) == 1).when(k == 2, F.get(f, F.lit(2)) == 1)
        .otherwise(F.get(f, F.lit(1)).between(9, 15) & (F.get(f, F.lit(6)) == 1))
    )
    return form & ~F.get(f, F.lit(8)).isin(1, 2) & ~F.get(f, F.lit(9)).isin(1, 2) & (F.get(f, F.lit(10)) != 2)


def _broken(k: Column, plain: Column) -> Column:
    """A base span with a part missing or a digit wrong."""
    digit = F.translate(F.right(plain, F.lit(1)), "0123456789", "1234567890")
    return (
        F.when(k == 0, F.regexp_replace(plain, r"\.[^@]*$", ""))
        .when(k == 1, F.regexp_replace(plain, r"\.[0-9]+$", ""))
        .when(k == 2, F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), digit))
        .otherwise(F.regexp_replace(plain, r"[0-9]{3}$", ""))
    )


def _misplaced(x: Column) -> list[Column]:
    """The context of a base span inside a longer word, or after words that
    announce other numbers: which one depends on where the span is."""
    inside = x["start"] % 2 == 0
    return [F.when(inside, 1).otherwise(0), F.when(inside, 1).otherwise(0), F.when(inside, 0).otherwise(2)]


def _judged(x: Column, f: Column, label: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), f.alias("f"), label.alias("label"))


def _ordered(spans: Column, order) -> Column:
    """``spans`` without repeats, sorted by ``order`` of each, which is unique."""

    def unique(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: (i == 0) | (order(F.get(xs, F.greatest(i - 1, F.lit(0)))) != order(x)))

    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(order(x).alias("o"), x.alias("x"))))
    return _let(F.transform(keyed, lambda x: x["x"]), unique)


def _place(x: Column) -> Column:
    return F.struct(x["start"], x["k"], x["end"])


def with_spans(docs: DataFrame, base: str = "_base", more: str = "_more") -> DataFrame:
    """``docs`` with ``base`` and ``more``: the base spans, in order, and the
    proposals that touch none of them, with features.  The label of a proposal
    is 0 where it is no valid form and null where it is to be judged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.flatten(F.array(*[F.filter(_found(text, k, p), _valid) for k, p in enumerate(BASE)]))
    proposed = F.flatten(F.array(*[_found(text, k, p) for k, p in PROPOSE]))
    hinted = text.rlike(HINT)
    none = F.array().cast(_SPAN)
    rows = docs.withColumn(base, _ordered(F.when(hinted, found).otherwise(none), _place))
    rows = rows.withColumn(more, F.when(hinted, proposed).otherwise(none))

    def clear(taken: Column) -> Column:
        def free(x: Column) -> Column:
            before = _below(taken["starts"], x["end"])
            return _let(before, lambda n: (n == 0) | (F.get(taken["ends"], n - 1) <= x["start"]))

        return F.filter(more, free)

    starts = F.transform(base, lambda b: b["start"])
    ends = running(F.transform(base, lambda b: b["end"].cast("long")), _most)
    free = F.when(F.size(base) == 0, F.col(more)).otherwise(_let(F.struct(starts.alias("starts"), ends.alias("ends")), clear))
    rows = rows.withColumn(more, _ordered(free, _place))

    def judged(x: Column) -> Column:
        f = _features(x["k"], _plain(x["value"]), _context(x))
        return _let(f, lambda f: _judged(x, f, F.when(~_is_valid(f), F.lit(0))))

    return rows.withColumn(more, F.transform(more, judged))


def _cases(base: str) -> Column:
    """Base spans as positive cases, broken and misplaced ones as negative."""

    def three(x: Column) -> Column:
        def made(plain: Column) -> Column:
            context = _context(x)
            return F.array(
                _judged(x, _features(x["k"], plain, context), F.lit(1)),
                _judged(x, _features(x["k"], _broken(x["k"], plain), context), F.lit(0)),
                _judged(x, _features(x["k"], plain, _misplaced(x)), F.lit(0)),
            )

        return _let(_plain(x["value"]), made)

    return F.flatten(F.transform(base, three))


# A tree is a leaf (a number) or (feature, bound, tree up to the bound, tree above it).


def tree_value(tree, f) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    at, bound, low, high = tree
    return F.when(F.get(f, F.lit(at)) <= bound, tree_value(low, f)).otherwise(tree_value(high, f))


class Model:
    def __init__(self, start: float, trees: list, limits: list[float]):
        self.start, self.trees, self.limits = start, trees, limits

    def score(self, f) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree_value(tree, f)
        return total

    def accepts(self, x: Column) -> Column:
        limit = F.get(F.array(*[F.lit(v) for v in self.limits]), x["k"])
        return self.score(x["f"]) >= limit


def _best(sums: list, node: int) -> tuple | None:
    """The split of a node with the greatest gain, and its leaf values."""
    by: dict[int, dict[int, tuple[float, float]]] = {}
    for r in sums:
        if r["node"] == node:
            by.setdefault(r["feature"], {})[r["value"]] = (r["g"], r["h"])
    best = None
    for feature, values in sorted(by.items()):
        g_all, h_all = (sum(v[i] for v in values.values()) for i in (0, 1))
        g, h = 0.0, 0.0
        for bound in sorted(values)[:-1]:
            g, h = g + values[bound][0], h + values[bound][1]
            gain = g * g / (h + LEAF) + (g_all - g) ** 2 / (h_all - h + LEAF) - g_all**2 / (h_all + LEAF)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, feature, bound, RATE * g / (h + LEAF), RATE * (g_all - g) / (h_all - h + LEAF))
    return best


def fit(counts: DataFrame, rounds: int = ROUNDS, held: DataFrame | None = None) -> Model:
    """Boosted trees of depth two from ``f, n, pos``: distinct feature vectors,
    how often they come and how often as positive cases; ``held`` has the cases
    that calibrate, else the same do.

    Each level of a tree is one sum over (node, feature, value).  Without both
    labels, or for a kind without positive cases, nothing is accepted.
    """
    total = counts.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    if not total["pos"] or total["pos"] == total["n"]:
        return Model(0.0, [], [math.inf] * len(KINDS))
    share = total["pos"] / total["n"]
    model = Model(math.log(share / (1 - share)), [], [math.inf] * len(KINDS))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.score(F.col("f"))))
        rows = counts.withColumn("g", F.col("pos") - F.col("n") * p).withColumn("h", F.col("n") * p * (1 - p))

        def level(node: Column, rows=rows) -> list:
            each = rows.select(node.alias("node"), "g", "h", F.posexplode("f").alias("feature", "value"))
            sums = each.groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            return sums.collect()  # nodes x features x values, none above 40

        top = _best(level(F.lit(0)), 0)
        if top is None:
            break
        _, feature, bound, low, high = top
        sides = level(F.when(F.get(F.col("f"), F.lit(feature)) <= bound, 0).otherwise(1))
        under = [_best(sides, 0), _best(sides, 1)]
        model.trees.append((feature, bound, *[b[1:] if b else leaf for b, leaf in zip(under, (low, high))]))
    model.limits = calibrate(model, counts if held is None else held)
    return model


def calibrate(model: Model, counts: DataFrame, precision: float = PRECISION) -> list[float]:
    """For each kind the least score above which the share of positive cases
    is at least ``precision``; beyond all scores without such a one."""
    limits = [math.inf] * len(KINDS)
    steps = F.floor(model.score(F.col("f")) * 32)
    tally = counts.groupBy(F.get(F.col("f"), F.lit(0)).alias("k"), steps.alias("step")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()
    for k in range(len(KINDS)):
        n = pos = 0
        for r in sorted((r for r in tally if r["k"] == k), key=lambda r: -r["step"]):
            n, pos = n + r["n"], pos + r["pos"]
            if pos and pos >= precision * n:
                limits[k] = r["step"] / 32
    return limits


def learn(spanned: DataFrame, base: str = "_base", more: str = "_more", key: str = "doc_id") -> Model:
    """A model from the spans of all documents.  A part of the documents, by
    their ids, only calibrates; without spans there the others do."""
    cases = F.concat(_cases(base), F.filter(more, lambda x: x["label"] == 0))
    held = (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % PARTS) == 0
    rows = spanned.select(held.alias("held"), F.explode(cases).alias("e")).select("held", "e.f", "e.label")
    counts = rows.groupBy("held", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    counts = materialize(counts, "formats")
    apart = counts.filter("held")
    return fit(counts.filter("NOT held"), held=None if apart.isEmpty() else apart)


def _accepted(model: Model, more: str = "_more") -> Column:
    """Proposals the model takes; of a kind, none that lies in another."""
    taken = F.filter(more, lambda x: x["label"].isNull() & model.accepts(x))

    def code(x: Column) -> Column:
        return x["k"].cast("long") * (1 << 40) + x["end"]

    def outer(xs: Column) -> Column:
        ends = running(F.transform(xs, code), _most)
        return _let(ends, lambda e: F.filter(xs, lambda x, i: (i == 0) | (code(x) > F.get(e, F.greatest(i - 1, F.lit(0))))))

    return F.when(F.size(taken) == 0, F.array().cast(_JUDGED)).otherwise(_let(_ordered(taken, lambda x: F.struct(x["k"], x["start"], -x["end"])), outer))


def _all(base: str, accepted: Column) -> Column:
    """``start, k, end`` of all spans, in order."""
    return F.array_sort(F.concat(*[F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))) for s in (F.col(base), accepted)]))


def _written(spans) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every
    document; the counts are of base spans, ``spans`` lists base and added ones.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  A null
    text counts as empty and has no spans; repeated rows are judged each; an
    empty table gives an empty result.
    """
    found = materialize(with_spans(docs.select("doc_id", "text")).select("doc_id", "_base", "_more"), "spans")
    model = learn(found)
    counts = [F.size(F.filter("_base", _of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = _written(_all("_base", _accepted(model)))
    return found.select("doc_id", *counts, F.sha2(_written("_base").cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def _of(k: int):
    return lambda x: x["k"] == k


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping ``spans`` replaced by the kind of
    its first.  Pieces are cut from blocks of the text, not from its start."""
    size = 1000
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def made(x: Column) -> Column:
        blocks, spans, ends = x["blocks"], x["spans"], x["ends"]

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor((b + size - 1) / size).cast("int") - first), "")
            return F.substring(held, a % size + 1, b - a)

        def one(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, F.greatest(i - 1, F.lit(0)))).cast("int")
            return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), F.get(tags, s["k"]))).otherwise("")

        tail = F.when(F.element_at(ends, -1) < F.length(text), piece(F.element_at(ends, -1).cast("int"), F.length(text))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, one), ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"].cast("long")), _most)
    return _let(F.struct(blocks.alias("blocks"), spans.alias("spans"), ends.alias("ends")), made)


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns and rows, with each span of a text replaced by its
    kind in brackets; overlapping spans become one.  Where there is a column
    ``n_chars`` it holds the new length of a changed text; all other columns,
    whatever their names, stay.  Null texts stay null; an empty table gives an
    empty result.  Spans are found once, in a written table."""
    names = docs.columns
    base, more, kept, spans = (fresh(x, names) for x in ("_base", "_more", "_kept", "_spans"))
    # user columns travel as one struct, so that no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias(kept)
    given = docs.select(row, *[F.col(c) for c in ("doc_id", "text")])
    found = materialize(with_spans(given, base, more).select(kept, base, more), "spans")
    key = fresh("_key", names)
    model = learn(found.select(F.col(kept)["doc_id"].alias(key), base, more), base, more, key)
    rows = found.withColumn(spans, _all(base, _accepted(model, more)))
    text = F.col(kept)["text"]
    changed = F.size(spans) > 0
    rows = rows.withColumn(key, F.when(changed, _replaced(text, F.col(spans))).otherwise(text))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(key).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length(key).cast(docs.schema[c].dataType)).otherwise(F.col(kept)[c]).alias(c)
        return F.col(kept)[c].alias(c)

    return rows.select(*[column(c) for c in names])
