"""Filter audit, phrases and line dedup against plain code, over odd rows and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardsieve.llm import bit_table, filter_audit, line_dedup, phrases

WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    shared = ["Shared LINE of text", "another shared line", "  shared line OF text\t"]
    rows = [
        (1, None, "en"),
        (2, "", None),
        (3, " \t\x0b ", ""),
        (4, "A b C d # e", "en"),
        (4, "A b C d # e", "en"),
        (None, "A b C d # e", "de"),
        (None, "A b C d # e", "de"),
        (5, "A b C d # e", "und"),
        (5, "other text of the same id\n\nShared line of text", "en"),
        (6, "x y " * 30_000 + "\n" + "z" * 100_000, "en"),
        (7, "naïve éte ÀÀ İ ß. naïve éte, ÀÀ İ ß x", "fr"),
        (8, "\n\n\n", "fr"),
    ]
    for i in range(9, 60):
        words = " ".join(rng.choice("ab cd ef gh of to in it".split()) for _ in range(rng.randint(3, 250)))
        lines = [words.replace("of to", "of, to"), rng.choice(shared), rng.choice(["", "own " + str(i)]), shared[0]]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", None, "und"])))
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    return found.selectExpr(
        "*", "1 AS n", "'k' AS key", "2 AS line", "3 AS part", "0 AS fails", "'q' AS content", "4 AS block", "5 AS phrase"
    )


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (9, 1, None), (999, 1, 1)]
    return spark.createDataFrame(
        [*rows, *((i, i % 2, i % 3 % 2) for i in range(10, 40))], "doc_id long, quality int, toxic int"
    )


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_audit_equals_running_every_order(spark, odd, labels):
    rows = [(r.doc_id, r.text or "", r.lang or "") for r in odd.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    least = defaultdict(lambda: None)
    for doc_id, text, _ in rows:
        if doc_id is not None and (least[text] is None or doc_id < least[text]):
            least[text] = doc_id

    def fails(doc_id, text):
        words = split_words(text)
        return {
            f
            for f, failed in zip(
                "ABCDE",
                (
                    len(words) < 200,
                    100 * len(set(words)) < 50 * len(words),
                    100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                    any(c in "#$%&*|" for c in text),
                    doc_id is not None and doc_id > least[text],
                ),
            )
            if failed
        }

    wanted, shapley = {}, Counter()
    for part in {r[2] for r in rows}:
        own = [(d, fails(d, t)) for d, t, p in rows if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d, failed in left if f in failed]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                failing = [failed for _, failed in own if f in failed]
                wanted[part, "".join(order), step] = (
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    sum(len(failed) == 1 for failed in failing),
                    sum(d in good for d in gone),
                    sum(d in toxic for d in gone),
                )
    got = filter_audit.audit_orders(filter_audit.failures(odd), labels).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert wanted[r.part, r.filter_order, r.step] == (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost
        )
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_other_filters(spark, labels):
    failed = spark.createDataFrame(
        [(1, "p", [True, False]), (2, "p", [True, True]), (3, "p", [False, False])],
        "doc_id long, part string, fails array<boolean>",
    )
    got = filter_audit.audit_orders(failed, labels.limit(0), "XY").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {
        ("XY", 1): (1, 2, 0, 1, 3),
        ("XY", 2): (1, 0, 1, 0, 1),
        ("YX", 1): (2, 1, 0, 0, 1),
        ("YX", 2): (1, 1, 1, 1, 3),
    }


def plain_lines(rows, how):
    """What stays, by running through all rows in order."""

    def key(line):
        out = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
        return out if len(out) >= how.min_chars else None

    found = Counter(k for _, t in rows for k in {key(line) for line in t.split("\n")} if k is not None)
    firsts = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, line_digest(r[1]))):
        for j, line in enumerate(text.split("\n")):
            firsts.setdefault(key(line), (doc_id, text, j))
    out = []
    for doc_id, text in rows:
        lines = text.split("\n")
        gone = [
            j
            for j, line in enumerate(lines)
            if (k := key(line)) is not None
            and found[k] >= how.min_documents
            and not (how.keep_first and firsts[k] == (doc_id, text, j))
        ]
        out.append((doc_id, len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return sorted(out, key=repr)


def line_digest(text):
    return hashlib.md5(text.encode()).digest()


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("least, chars, lookup", [(10, 1, True), (10, 1, False), (2, 0, True), (2, 20, False)])
def test_line_dedup_equals_plain_code(odd, least, chars, keep_first, lookup):
    how = line_dedup.LineDedup(least, chars, keep_first, broadcast_lines=10**6 if lookup else -1)
    got = line_dedup.dedup_lines(odd, how).collect()
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted(map(tuple, got), key=repr) == plain_lines(rows, how)


def test_full_filters_change_nothing(spark):
    """With far fewer bits than lines every line is a suspect, and only that."""
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(0, 999), i -> concat(id * (i % 7), '-', i)), '\n') AS text"
    )
    small = line_dedup.LineDedup(5, keep_first=False, most_bits=1 << 16)
    large = line_dedup.LineDedup(5, keep_first=False)
    assert line_dedup.filter_size(docs, small) == 1 << 16 < line_dedup.filter_size(docs, large)
    one, two = (line_dedup.dedup_lines(docs, how) for how in (small, large))
    assert one.exceptAll(two).count() == 0 and one.agg(F.sum("n_dropped")).first()[0] > 0


def plain_phrases(rows, how):
    counts = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, how.longest + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        n = sum(c for p, c in found.items() if len(p) == 1)
        frequent = {p: c for p, c in found.items() if len(p) > 1 and c >= how.least}
        scored = []
        for p, a in frequent.items():
            if any(
                len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in frequent.items()
            ):
                continue
            score, k = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            text = " ".join(p)
            scored.append((-score, -a, text.encode(), text, found[p[:k]], found[p[k:]]))
        for rank, (s, a, _, text, left, right) in enumerate(sorted(scored)[: how.top], 1):
            out.append((lang, rank, text, -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("least, longest, top, bits", [(3, 5, 2000, 1 << 27), (2, 5, 25, 1 << 15), (20, 2, 2000, 1 << 27), (5, 7, 50, 1 << 20)])
def test_phrases_equal_plain_code(odd, least, longest, top, bits):
    how = phrases.Phrases(longest, least, top, table_bits=bits)
    got = sorted(map(tuple, phrases.collocations(odd, how).collect()))
    assert got and got == plain_phrases([(r.text, r.lang) for r in odd.collect()], how)


def test_phrase_numbers_beyond_63_bits():
    """Words are dealt new numbers where their product no longer fits."""
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500) * 60_000
    at, counts = phrases._count(ids, np.arange(496), 5, 200_000)
    wanted = Counter(tuple(ids[i : i + 5]) for i in range(496))
    assert {tuple(ids[i : i + 5]): c for i, c in zip(at, counts)} == wanted


def test_scores_beyond_64_bits(spark):
    """The products of the score pass 64 bits and stay exact."""
    counts = spark.createDataFrame(
        [("en", "a b", 3_000_000_000_000, [4_000_000_000_000], [5_000_000_000_001], None)],
        "lang string, phrase string, n long, lefts array<long>, rights array<long>, extended long",
    )
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n long")
    row = phrases.rank_phrases(counts, totals, phrases.Phrases()).first()
    assert row.score == 1000 * 3_000_000_000_000 * 9_000_000_000_000 // (4_000_000_000_000 * 5_000_000_000_001)


def test_bit_table_has_all_it_was_given(spark):
    bits = 1 << 16
    taken = [0, 1, 32_767, 32_768, 65_535]
    table = bit_table.collect_bits(spark.createDataFrame([(p,) for p in taken], "place long"), bits)
    assert np.flatnonzero(np.unpackbits(table, bitorder="little")).tolist() == taken
    hashes = np.array([32_768 << 32 | 1, 2], np.uint64)
    assert bit_table.may_hold(table, hashes).tolist() == [True, False]


def test_empty_tables(odd, labels):
    none = odd.limit(0)
    assert filter_audit.audit_orders(filter_audit.failures(none), labels).collect() == []
    assert line_dedup.dedup_lines(none).collect() == []
    assert phrases.collocations(none).collect() == []
