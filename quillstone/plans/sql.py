"""DuckDB spellings of the text functions, for the queries' SQL."""

from quillstone.functions import values as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(str_split({x}, chr(10)), lambda z: {strip('z')}), lambda z: z <> '')"


def join(x: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({x}, {sep}), '')"


def normalize(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({x}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10)||chr(10), 'g')")


def letters(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}]', '', 'g')"


def count_in(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"


def distinct_chars(x: str) -> str:
    return f"len(list_distinct(list_filter(str_split({x}, ''), lambda c: c <> '')))"


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def chain(x: str, rules) -> str:
    for old, new in rules:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return x


def phrases(x: str) -> str:
    for pattern, new in V.PHRASES:
        x = f"regexp_replace({x}, {q('(?i)' + pattern)}, {q(new)}, 'g')"
    return x


def table(rules: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in rules.items()) + "}"


def upper_first(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


def cased(found: str, w: str) -> str:
    return rf"CASE WHEN {found} IS NULL THEN {w} WHEN regexp_matches({w}, '^\p{{Lu}}') THEN {upper_first(found)} ELSE {found} END"


def restore_exact(x: str) -> str:
    return join(f"list_transform({words(x)}, lambda w: {cased(f'{table(V.MARKED)}[lower(w)]', 'w')})")


def restore_prefix(x: str) -> str:
    keys = "[" + ", ".join(f"{{'k': {q(k)}, 'v': {q(v)}}}" for k, v in V.MARKED.items()) + "]"
    first = f"list_filter({keys}, lambda r: starts_with(lower(w), r.k))[1].v"
    return join(f"list_transform({words(x)}, lambda w: {cased(first, 'w')})")


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def is_list(x: str) -> str:
    return f"len(list_filter({lines(x)}, lambda z: regexp_matches(z, {q(V.LIST_ITEM)}))) > 0"


def ends_heading(x: str) -> str:
    return f"regexp_matches({strip(x)}, '[.:;,]$')"


def mostly_upper(x: str) -> str:
    return rf"(length({letters(x)}) > 0 AND length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g')) / length({letters(x)}) >= 0.72)"


def garbage(x: str) -> str:
    dense = f"replace({x}, ' ', '')"
    return rf"(length({x}) < 2 OR {distinct_chars(dense)} <= 1 OR (length({x}) > 5 AND length({letters(x)}) < length({x}) * 0.3) OR regexp_matches({dense}, '^\p{{Nd}}+$'))"


def hallucinates(x: str) -> str:
    w = words(x)
    most = f"list_max(map_values(list_aggregate({w}, 'histogram')))"
    return f"(len({w}) > 3 AND coalesce({most} / len({w}) > 0.3, FALSE))"


def artifact(x: str) -> str:
    return f"list_contains({listed(V.ARTIFACTS)}, {strip(x)})"


ALL_VI = V.VIETNAMESE_LOWER + V.VIETNAMESE_UPPER


def quality(x: str) -> str:
    """A scalar over the text ``x``; ``x`` is evaluated a few times."""
    letter = "[A-Za-zÀ-ỹĐđ]"
    marks = "()\\[\\]{}\"''“”‘’.,;:!?"
    bare = f"list_transform(tk, lambda w: regexp_replace(w, '^[{marks}]+|[{marks}]+$', '', 'g'))"

    def hits(test: str) -> str:
        return f"len(list_filter(bare, lambda w: {test}))"

    mixed = hits(f"regexp_matches(w, '{letter}[0-9]|[0-9]{letter}')")
    shouted = hits("length(w) >= 14 AND regexp_matches(w, '^[A-ZĐÀ-Ỵ]+$')")
    endless = hits(r"length(w) >= 18 AND regexp_matches(w, '^\p{L}+$')")
    quoted = hits("regexp_matches(w, '[''’]')")
    common = hits(f"list_contains({listed(V.QUALITY_WORDS)}, lower(w))")
    n = "greatest(1, len(tk))"
    vi = f"{count_in('nt', ALL_VI)} / greatest(1, length({letters('nt')}))"
    score = (
        f"CAST(1 AS DOUBLE) - ({mixed} + {shouted} + {endless}) / {n} * 1.2 - {mixed} / {n} * 1.4 - {shouted} / {n} * 0.9 - {quoted} / {n} * 0.35"
        f" + least(0.2, {common} / {n} * 0.35) + least(0.15, {vi} * 0.5)"
    )
    return (
        f"SELECT doc_id, nt, CASE WHEN nt = '' THEN 0.0::DOUBLE WHEN len(tk) = 0 THEN 0.2::DOUBLE ELSE greatest(0, least(1, {score}))::DOUBLE END AS quality FROM "
        f"(SELECT *, {bare} AS bare FROM (SELECT doc_id, nt, list_filter(regexp_split_to_array(nt, '\\s+'), lambda w: regexp_matches(w, '{letter}')) AS tk FROM (SELECT doc_id, {normalize('text')} AS nt FROM {x}) n0) n1) n2"
    )


def overlap(a: str, b: str) -> tuple[str, str]:
    return f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))", f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def ratio(a: str, b: str) -> str:
    w, h = overlap(a, b)
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0::DOUBLE ELSE {w} * {h} / greatest(1.0, {area(a)}) END"


def iou(a: str, b: str) -> str:
    w, h = overlap(a, b)
    union = f"({area(a)} + {area(b)} - {w} * {h})"
    return f"CASE WHEN {w} < 0 OR {h} < 0 OR {union} <= 0 THEN 0.0::DOUBLE ELSE {w} * {h} / {union} END"
