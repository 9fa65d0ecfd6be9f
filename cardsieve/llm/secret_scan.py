"""Secret scan by DataFrame functions only: three patterns, and sliding-window entropy.

The patterns find assignments, access keys and long hex strings. The entropy method looks at
every run of 20 or more key characters: a window moves over it, one character goes and one
comes, and the sum of c * log2(c) over the counts c of its characters follows from the two
counts that change. Windows above the threshold of their character class are joined to
spans, unless the run is on the allow list.

Long texts take time in proportion to their length: characters and matches are looked up by
place in arrays that are made once, and folds that collect results stop after `_FOLD` of them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns. Letters of the key word stand in either case.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Results that one fold collects, since it copies them with every step.
_FOLD = 256
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")


@dataclass(frozen=True)
class SecretScan:
    """Settings of the entropy method; entropies are in bits per character."""

    window: int = 20
    hex_bits: float = 3.0
    text_bits: float = 3.8
    # Runs that are no secrets: words, numbers, UUIDs, paths, ladders of letters, stand-ins.
    allowed: tuple[str, ...] = (
        r"^[A-Za-z_=+/-]*$",
        r"^[0-9_=+/-]*$",
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^/?([a-z0-9_-]{1,15}/)+[a-z0-9_-]{0,15}$",
        r"(?i)abcdefgh|01234567|example|placeholder|dummy|xxxxx",
    )


def _bound(value: str, name: str, body: str) -> str:
    """SQL for `body` in which `name` is the value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running_sums(numbers: str) -> str:
    """SQL for the sums of all numbers before each place, and behind the last one."""
    n = f"size({numbers})"

    def fold(begin: str, places: str, term: str) -> str:
        return f"""aggregate({places}, named_struct('at', {begin}, 'out', CAST(array() AS array<bigint>)),
            (s, j) -> named_struct('at', s.at + {term}, 'out', concat(s.out, array(s.at))), s -> s.out)"""

    chunk = f"sequence(c, least(c + {_FOLD - 1}, {n} - 1))"
    sums = f"transform(sequence(0, {n} - 1, {_FOLD}), c -> aggregate({chunk}, 0L, (t, j) -> t + {numbers}[j]))"
    bases = _bound(sums, "sums", fold("0L", "sequence(0, size(sums) - 1)", "sums[j]"))
    inner = fold("bases[k]", f"sequence(k * {_FOLD}, least(k * {_FOLD} + {_FOLD - 1}, {n} - 1))", f"{numbers}[j]")
    return _bound(bases, "bases", f"flatten(transform(sequence(0, size(bases) - 1), k -> {inner}))")


def _placed(text: str, pattern: str, group: int) -> str:
    """SQL for (begin, found, part) of every match: the rest of the text, cut at matches,
    tells where each one begins, in code points."""
    cells = f"""
        zip_with(split({text}, {pattern}, -1), arrays_zip(regexp_extract_all({text}, {pattern}, 0),
            regexp_extract_all({text}, {pattern}, {group})),
            (gap, m) -> named_struct('gap', CAST(length(gap) AS BIGINT), 'found', m['0'], 'part', m['1']))"""
    lengths = "transform(cells, x -> x.gap + coalesce(length(x.found), 0))"
    # The last gap has no match behind it.
    found = f"""
        zip_with(slice(cells, 1, size(cells) - 1), slice({_bound(lengths, 'sizes', _running_sums('sizes'))}, 1, size(cells) - 1),
            (x, at) -> named_struct('begin', at + x.gap, 'found', x.found, 'part', x.part))"""
    return _bound(cells, "cells", found)


def _literal(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(kind: str, found: str, condition: str) -> str:
    return (
        f"transform(filter({found}, m -> {condition}), m -> named_struct('begin', m.begin,"
        f" 'kind', {KINDS.index(kind)}, 'stop', m.begin + length(m.found)))"
    )


def _entropy_spans(found: str, how: SecretScan) -> str:
    """SQL for the spans of all candidate runs by both character classes.

    `codes` are the characters of a run; the window of place i begins there.
    """
    w = how.window
    allowed = _literal("|".join(f"(?:{p})" for p in how.allowed))

    def count(code: str, first: str) -> str:
        """How often a character stands in the window of a place."""
        return f"aggregate(sequence({first}, {first} + {w - 1}), 0, (t, k) -> t + IF(get(codes, k) = {code}, 1, 0))"

    def log(n: str) -> str:
        return f"IF({n} > 0, {n} * log2({n}), 0D)"

    whole = f"aggregate(sequence(i, i + {w - 1}), 0D, (u, j) -> u + log2({count('get(codes, j)', 'i')}))"
    # One character goes and lowers its count, one comes and raises its own.
    moved = _bound(
        f"named_struct('go', {count('get(codes, i - 1)', 'i - 1')}, 'come', {count(f'get(codes, i + {w - 1})', 'i - 1')})",
        "x",
        f"s.sum - {log('x.go')} + {log('(x.go - 1)')} - {log('x.come')} + {log('(x.come + 1)')}",
    )
    same = f"get(codes, i - 1) = get(codes, i + {w - 1})"
    step = _bound(
        f"CASE WHEN i = c THEN {whole} WHEN {same} THEN s.sum ELSE {moved} END",
        "now",
        "named_struct('sum', now, 'out',"
        f" IF(log2({w}D) - now / {w} >= m.bits - 1e-9, concat(s.out, array(i)), s.out))",
    )
    last = f"size(codes) - {w}"
    starts = f"""
        flatten(transform(sequence(0, {last}, {_FOLD}), c -> aggregate(
            sequence(c, least(c + {_FOLD - 1}, {last})),
            named_struct('sum', 0D, 'out', CAST(array() AS array<int>)),
            (s, i) -> {step}, s -> s.out)))"""
    # Windows that meet or overlap are one span.
    spans = f"""
        zip_with(filter(starts, (a, j) -> j = 0 OR a - starts[j - 1] > {w}),
            filter(starts, (a, j) -> j = size(starts) - 1 OR starts[j + 1] - a > {w}),
            (a, z) -> named_struct('begin', m.begin + a, 'kind', m.kind, 'stop', m.begin + z + {w}))"""
    codes = "transform(filter(split(m.found, ''), x -> x <> ''), x -> ascii(x))"
    windows = _bound(codes, "codes", _bound(starts, "starts", spans))
    classed = f"""
        transform(filter({found}, m -> NOT m.found RLIKE {allowed}), m -> named_struct(
            'begin', m.begin, 'found', m.found,
            'kind', CASE WHEN m.found RLIKE '^[0-9a-fA-F]+$' THEN {KINDS.index('entropy_hex')}
                ELSE {KINDS.index('entropy_text')} END,
            'bits', CASE WHEN m.found RLIKE '^[0-9a-fA-F]+$' THEN {how.hex_bits}D ELSE {how.text_bits}D END))"""
    return f"flatten(transform({classed}, m -> {windows}))"


def scan_secrets(docs: DataFrame, how: SecretScan = SecretScan()) -> DataFrame:
    """Every column of `docs` and `secret_spans`, an array of (begin, kind, stop) in order.

    Kind is a place in KINDS; places count code points, and `stop` is the first one behind.
    Null and empty texts have an empty array. A column named secret_spans is replaced. Rows
    that repeat are scanned each for itself; no row moves. An empty table stays empty.
    """
    none = "CAST(array() AS array<struct<begin: bigint, kind: int, stop: bigint>>)"
    text = "coalesce(text, '')"

    def when(test: str, spans: str) -> str:
        return f"CASE WHEN {test} THEN {spans} ELSE {none} END"

    run = rf"[A-Za-z0-9+/_=-]{{{how.window},}}"
    # Most texts hold none of these: a plain test comes before the cutting.
    named = " OR ".join(
        f"contains(lower({text}), '{word}')" for word in ("passw", "secret", "token", "api")
    )
    parts = [
        when(
            f"({named}) AND {text} RLIKE {_literal(ASSIGN)}",
            _spans("assign", _placed(text, _literal(ASSIGN), 2), "length(m.part) >= 8"),
        ),
        when(
            f"contains({text}, 'AKIA')", _spans("access", _placed(text, _literal(ACCESS), 0), "true")
        ),
        when(
            f"{text} RLIKE {_literal(HEX)}", _spans("hex", _placed(text, _literal(HEX), 0), "true")
        ),
        when(
            f"{text} RLIKE {_literal(run)}",
            _entropy_spans(_placed(text, _literal(run), 0), how),
        ),
    ]
    return docs.withColumn("secret_spans", F.expr(f"array_sort(concat({', '.join(parts)}))"))


def span_text(spans: str, kinds: int = len(KINDS)) -> Column:
    """`kind:start:end`, comma-joined, of the spans whose kind is below `kinds`."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(filter({spans}, s -> s.kind < {kinds}),"
        f" s -> concat(element_at(array({names}), s.kind + 1), ':', s.begin, ':', s.stop)), ',')"
    )
