import re

import pytest

from meterwise.llm import pii

SCHEMA = "doc_id long, text string, base string, key int"
SPECIFIED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for place, (kind, pattern) in enumerate(SPECIFIED):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end(), kind))
    return sorted(out)


CASES = [
    None, "", " ", "no data here",
    "a@b.c a@b a@b.com.c@d.com a@b.com_c@d.com x..y@-.- @z.q", "é a.b+c%d@x-1.co😀 e@f.gg", "ab@c d@e.f@g.h",
    "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.1 1.2.3 99999999999999999999.1.1.1 1.2.3.4567",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 12345678901234567890 4111  1111 11111111",
    "+1 (487) 555-7209 +1 2 +12345678901234567 ++49 30 1234567. +1( +4930(123)4567-",
    "😀😀 mail: +1.2.3.4@5.6.7.8 4111111111111111@x.y",
    "a" * 2_000 + " " + "b" * 2_000 + "@c" + ".d" * 20_000 + " " + "7 " * 30_000,
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(CASES)], SCHEMA)
    return {r.id: r for r in pii.find(df).collect()}


def test_base_spans_match_the_specified_patterns(found):
    assert len(found) == len(CASES)
    for i, text in enumerate(CASES):
        assert [tuple(s)[:4] for s in found[i].base] == plain(text), text and text[:80]


def test_terms_that_disclose_are_added_and_only_near_entities(spark):
    rows, n = [], 0
    for i in range(12):
        rows.append((n := n + 1, f"Note {i} word{'abcdefghijkl'[i]}q: Zorblax wrote from boss@corp.example today about things.", "", 0))
    for i in range(200):
        rows.append((n := n + 1, f"Note that she wrote clean text from home about things today, number {i}.", "", 0))
    rows += [(n + 1, "Far from any address Zorblax is a word like others.", "", 0)] + [(n + 2, "copied Onlyhere me@once.example text", "", 0)] * 2
    rows += [(n + 3 + i, "copied Onlyhere me@once.example text", "", 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in pii.find(df).collect()}
    text = {r[0]: r[1] for r in rows}
    added = {i: {text[i][s.start:s.end]: s.kind for s in r.added} for i, r in got.items() if r.added}
    assert set(added) == set(range(1, 13))
    assert all(a["Zorblax"] == "removed" for a in added.values())
    assert all("things" not in a and "today" not in a for a in added.values())
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(df).select("doc_id", "sanitised").collect()}
    assert "Zorblax" not in clean[1] and "[EMAIL]" in clean[1] and clean[1].startswith("Note 0 ")
    assert clean[20] == text[20]


def test_generalised_terms_keep_a_class(spark):
    rows = [(i, f"Item {'abcdefghij'[i]}xq: Quibbly at 10.0.0.{1} said so.", "", 0) for i in range(10)]
    rows += [(100 + i, f"Quibbly elsewhere {i}", "", 0) for i in range(20)] + [(200 + i, f"filler {i}", "", 0) for i in range(970)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert "[NAME]" in got[0] and "Quibbly" not in got[0] and got[100] == "Quibbly elsewhere 0"


def test_long_runs_without_a_match_stay_linear(spark):
    df = spark.createDataFrame([(1, "a" * 2_000_000 + " " + "9." * 500_000 + " +" + " " * 500_000 + "+1" * 200_000, "", 0)], SCHEMA)
    assert [r for r in pii.find(df).collect()[0].base if r.kind == "email"] == []


def test_empty_table_and_repeated_rows(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x@y.zz", "", 0), (1, "x@y.zz", "", 0), (1, None, "", 0), (None, "1.1.1.1", "", 0)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.id), len(r.base)) for r in got) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]


def test_rare_values_are_rated_as_their_class_over_whole_texts(spark):
    gap = "plain words of no use " * 8
    rows = [(i, f"Quibbly {'abcdefgh'[i] * 4} {gap} {'abcdefgh'[i] * 5} user{i}@corp.example {gap} said quibbly.", "", 0) for i in range(8)]
    rows += [(100 + i, f"{gap} {i}", "", 0) for i in range(400)] + [(900, "Quibbly stays here.", "", 0)]
    got = {r.id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows[:8]:
        marked = [text[s.start:s.end] for s in got[i].added]
        # Every value occurs once; the term stands more than 64 code points away, twice.
        assert [m for m in marked if m.lower() == "quibbly"] == ["Quibbly", "quibbly"]
        assert not {"plain", "words", "use"} & set(marked)
    assert not any(got[r[0]].added for r in rows[8:])


def test_repeated_rows_count_alike_in_all_shares(spark):
    rows = [(i, f"Zorblax {'abcdef'[i]}xx me@corp.example", "", 0) for i in range(6)] * 3
    rows += [(100 + i, f"Zorblax alone {i}", "", 0) for i in range(6)] + [(200 + i, "filler", "", 0) for i in range(976)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = pii.protected(docs, "doc_id", "text").cache()
    rated = pii.disclosures(found, docs, "text", pii.units_of(found))
    got = {(r.entity, r.term): r.disclosure for r in rated.collect()}
    from math import log2

    assert got["me@corp.example", "zorblax"] == pytest.approx(1 - log2(18 / 24) / log2(18 / 1000))


def test_disclosures_of_a_whole_table_match_plain_counts(spark):
    from collections import defaultdict
    from math import log2

    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(sf)
    found = pii.protected(docs, "doc_id", "text").cache()
    rated = pii.disclosures(found, docs, "text", pii.units_of(found, 2), min_contexts=2)
    got = {(r.kind, r.entity, r.term): r.disclosure for r in rated.collect()}

    texts = [t or "" for t in pq.read_table(sf).column("text").to_pylist()]
    terms = []
    for t in texts:
        found_terms = set()
        for m in re.finditer(r"(?<=[\s(\"'])[^\W\d_](?:[^\W\d_]|['’-]){2,}", " " + t + " "):
            if re.match(r"[,.;:!?)\"']{0,3}\s", (" " + t + " ")[m.end():]):
                found_terms.add(m.group().lower())
        terms.append(found_terms)
    with_term = defaultdict(int)
    for x in terms:
        for w in x:
            with_term[w] += 1
    # A document with several values has several contexts; here their set stands for the least.
    docs_of, contexts_of = defaultdict(int), defaultdict(set)
    joint, joint_contexts = defaultdict(int), defaultdict(set)
    for t, x in zip(texts, terms):
        units = defaultdict(set)
        for start, _, end, kind in plain(t):
            value = t[start:end]
            entity = value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
            context = (t[max(0, start - 64):start], t[end:end + 64])
            units[kind, entity].add(context)
            units[kind, None].add(context)
        for unit, seen in units.items():
            docs_of[unit] += 1
            contexts_of[unit].add(frozenset(seen) if len(seen) > 1 else next(iter(seen)))
            for w in x:
                joint[*unit, w] += 1
                joint_contexts[*unit, w].add(frozenset(seen) if len(seen) > 1 else next(iter(seen)))
    want = {}
    for (kind, entity, w), n in joint.items():
        if len(contexts_of[kind, entity]) >= 2 and len(joint_contexts[kind, entity, w]) >= 2:
            share, prior = docs_of[kind, entity] / len(texts), 0 if entity else pii.PRIOR
            want[kind, entity, w] = 1 - log2((n + prior * share) / (with_term[w] + prior)) / log2(share)
    assert len(want) > 50
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
