"""Operators 2, 5 and 8 against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from llm.conftest import MESSY, as_rows
from navframe.llm import contamination, licenses, pii
from navframe.llm.queries import QUERIES

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return (text or "").encode().lower().decode()


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (1 + i % 2)
        total += x if x < 10 else x - 9
    return total % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab.@-+1234 ()5%_é", "0123456789 -.", "+1(2) 3-4.56"])
def test_base_spans_are_the_patterns(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(8000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
        assert [s for s in pii.spans_of(text) if s[1] < 4] == base_spans(text), text


def test_spans_of_the_method():
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.spans_of(t) if k >= 4]
    assert found('a Token = "24be64439e3e49cf46b2" b') == [("secret", "24be64439e3e49cf46b2")]
    assert found("password=49b0203a9cc466e6ee x") == [("secret", "49b0203a9cc466e6ee")]
    assert found("token = correcthorsebattery") == []  # no digit
    assert found("IBAN GB82 WEST 1234 5698 7654 32 OK") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert found("IBAN: GB83WEST12345698765432") == []  # checksum
    assert found("SSN 123-45-6789.") == [("account", "123-45-6789")]
    assert found("account no. 123456789, on account of 12345678") == [("account", "123456789")]
    assert found("see https://user:pw@example.com/x and https://example.com") == [("url", "https://user:pw@example.com/x")]
    assert found("the keys to the kingdom, a token of love, on account of İstanbul") == []
    assert pii.masked("mail a.b@c.org or +1 (743) 555-3824!") == "mail <EMAIL> or <PHONE>!"


def test_find_and_mask_rows(spark, messy, nothing):
    extra = [(20, "İ x@y.zz 1.2.3.4"), (21, "9" * 100_000), (22, "a@" * 30_000), (23, "1." * 30_000)]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = [*MESSY, *extra]
    got = as_rows(pii.find_spans(docs), "doc_id", "starts", "ends")
    want = [(i, [s for s, _, _ in pii.spans_of(t or "")], [e for _, _, e in pii.spans_of(t or "")]) for i, t in rows]
    assert got == sorted(want, key=repr)
    masked = pii.mask(messy)
    assert masked.columns == messy.columns
    assert as_rows(masked, "doc_id", "text") == sorted(((i, t and pii.masked(t)) for i, t in MESSY), key=repr)
    assert pii.find_spans(nothing).count() == 0 and pii.mask(nothing).count() == 0


def test_pii_query_on_whole_texts(spark):
    import hashlib

    from conftest import SF01

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    for r in QUERIES["op2_pii_anchors"](spark, SF01).collect():
        base = base_spans(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert not base or set(text.split(",")) <= set(r["spans"].split(","))


# -- licences ----------------------------------------------------------------------


def base_places(text):
    words = re.findall(ALNUM, lower(text))
    out = []
    for k, phrase in enumerate(licenses.PHRASES):
        p = phrase.split()
        out += [(i, k) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_automaton_gives_matching_statistics():
    rng = random.Random(7)
    for _ in range(300):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        automaton = licenses.SuffixAutomaton(texts)
        read = [rng.randrange(4) for _ in range(12)]
        for i, (state, length) in enumerate(automaton.statistics(read)):
            at = lambda n, i=i: {(k, b + n) for k, t in enumerate(texts) for b in range(len(t) - n + 1) if t[b : b + n] == read[i + 1 - n : i + 1]}
            assert length == max(n for n in range(i + 2) if n == 0 or at(n))
            if length:
                assert automaton.ends[state] == at(length)


def test_chain_is_the_best():
    rng = random.Random(8)
    for _ in range(300):
        matches = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 7))]
        best = 0
        for mask in range(1, 1 << len(matches)):
            chosen = sorted(m for i, m in enumerate(matches) if mask >> i & 1)
            if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(m[2] for m in chosen))
        assert licenses.chain(matches)[0] == best


def test_places_of_phrases():
    rng = random.Random(9)
    words = "the MIT license Apache general public gnu version 2 licensed under foo".split()
    scan = licenses.scanner()
    for _ in range(4000):
        text = rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(30)))
        n, places, _ = scan.scan(text.encode())
        assert (n, sorted(places)) == base_places(text), text


def test_labels_of_templates(spark, messy, nothing):
    notice = licenses.TEMPLATES["mit-text"].replace("sublicense", "sub-license").upper()
    rows = [(1, "Preface. " + notice + " The end."), (2, "Released under the MIT License."), (3, "no licence here"), (4, "the license of the public")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["base_labels"] == "" and 0.9 < got[1]["score"] <= 1
    assert got[2]["base_labels"] == "mit" and got[2]["labels"] == "mit,mit-line" and (got[2]["first_word"], got[2]["last_word"], got[2]["n_base"]) == (3, 3, 1)
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0 and got[3]["first_word"] is None
    assert got[4]["labels"] == ""
    assert as_rows(licenses.scan(messy), "doc_id", "n_words", "n_base") == sorted(((i, base_places(t)[0], 0) for i, t in MESSY), key=repr)
    assert licenses.scan(nothing).count() == 0


def test_each_text_has_its_own_label_and_no_other():
    scan = licenses.scanner()

    def labels(text):
        covers = scan.scan(text.encode())[2]
        return set(licenses.given_labels({k: c[:4] for k, c in covers.items() if c[0] >= licenses.MIN_COVER and c[4]}))

    for label, text in licenses.TEMPLATES.items():
        assert labels(f"(c) 2020 someone. {text} And more words after it.") == {label.split("~")[0]}, label
    # two texts beside each other, and words changed or missing
    both = labels(licenses.TEMPLATES["isc-text"] + " Parts are licensed under the Mozilla Public License 2.0.")
    assert both == {"isc-text", "mpl-2.0-line"}
    words = licenses.TEMPLATES["bsd-3-clause"].split()
    assert labels(" ".join(w for i, w in enumerate(words) if i % 40 != 39)) == {"bsd-3-clause"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("licensed under the Mozilla Public License Version 2.0", {"mpl-2.0-line"}),
        ("Licensed under the MIT", set()),
        ("licensed under the GNU Lesser General Public License, version 3", {"lgpl-3.0-line"}),
        ("licensed under the GNU Affero General Public License, version 3", {"agpl-3.0-line"}),
        ("licensed under the GNU General Public License, version 2", {"gpl-2.0-line"}),
        ("licensed under CC BY 4.0", {"cc-by-4.0-line"}),
        ("licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0-line"}),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa-4.0-line"}),
        ("licensed under CC BY-NC 3.0", set()),
        ("licensed under the Apache Software License, Version 1.1", set()),
        ("not licensed under any public license, version 2.0 of the program", set()),
        ("the general public may use this software in source and binary forms", set()),
    ],
)
def test_lines_near_a_licence_get_no_false_label(text, want):
    covers = licenses.scanner().scan(text.encode())[2]
    assert set(licenses.given_labels({k: c[:4] for k, c in covers.items() if c[0] >= licenses.MIN_COVER and c[4]})) == want


def test_license_query_on_whole_texts(spark):
    from conftest import SF01

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op5_license_scan"](spark, SF01).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, places = base_places(docs[r["doc_id"]])
        labels = sorted({list(licenses.PHRASES.values())[k] for _, k in places})
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(filter(None, r["labels"].split(",")))


# -- decontamination ------------------------------------------------------------------


def hits(text, items, window):
    words = re.findall(ALNUM, lower(text))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(ALNUM, lower(body))
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_in_any_number_of_blocks(spark, messy, nothing):
    rng = random.Random(10)
    words = "a b c d é".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    items = [*((i, text(9)) for i in range(12)), (3, "a b"), (None, "c c c d"), (90, None), (91, ""), (92, "...")]
    rows = [(i, text(40)) for i in range(60)] + [(60, None), (60, ""), (None, "a b, A-B!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as n_words", "2 as `row`")
    for block_bytes in (1 << 20, 40):
        got = [(r["doc_id"], r["n_words"], sum(e - s for s, e in zip(r["hit_starts"], r["hit_ends"])), r["items"]) for r in contamination.scan(docs, bench, window=4, block_bytes=block_bytes).collect()]
        assert sorted(got, key=repr) == sorted(((i, *hits(t, items, 4)) for i, t in rows), key=repr)
    assert contamination.scan(nothing, bench).count() == 0
    assert {len(r["items"]) for r in contamination.scan(messy, bench.limit(0)).collect()} == {0}


def test_a_large_benchmark_takes_one_scan(spark, monkeypatch, messy):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(300)) for i in range(2000)] + [(5000, "w1 w2 w3"), (None, "w5 w6"), (5001, None)]  # 3 MB
    rows = [(i, line(40)) for i in range(60)]
    rows += [(100 + i, line(7) + " " + " ".join(items[i * 7][1].split()[20:33]) + " " + line(5)) for i in range(9)]
    rows += [(200, "x w1 w2 w3 y"), (201, "w5 w6 w7"), (202, None), (203, ""), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("may", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    scans, passes = [], []
    marked, scanned = contamination._marked, contamination._scanned
    monkeypatch.setattr(contamination, "_marked", lambda df, *a: scans.append(df.count()) or marked(df, *a))
    monkeypatch.setattr(contamination, "_scanned", lambda df, shared, *a, **k: passes.append(df.count() if shared else 0) or scanned(df, shared, *a, **k))
    got = contamination.scan(docs, bench, block_bytes=1 << 19).collect()
    assert scans == [len(rows)]  # all documents once; then those that may hit, a pass a block
    assert len(passes) > contamination.FEW_BLOCKS and set(passes) == {0, 11}
    want = {i: hits(t, [(items[(i - 100) * 7] if 100 <= i < 109 else (5000, "w1 w2 w3")), (None, "w5 w6")], 10) for i, t in rows if i >= 100}
    for r in got:
        found = (r["n_words"], sum(e - s for s, e in zip(r["hit_starts"], r["hit_ends"])), r["items"])
        assert found == want.get(r["doc_id"], (40, 0, []))
    assert len(got) == len(rows)
    small = [(1, "two rows of different ids"), (2, "row"), (3, None)]
    bench = spark.createDataFrame(small, "item_id bigint, text string")
    for most in (4_000_000, 1):  # hashes sent in one part, or one by one
        monkeypatch.setattr(contamination, "HASHES", most)
        rows = contamination.scan(messy, bench, few_blocks=0, block_bytes=10).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["items"]) for r in rows), key=repr) == sorted(((i, n, f) for i, t in MESSY for n, _, f in [hits(t, small, 10)]), key=repr)


def test_one_block_at_a_time_is_held(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x y")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, f"b c d n{k}") for k in range(8)] + [(9, "b c d")], "item_id bigint, text string")
    events = []
    blocks, store, broadcast = contamination._blocks, contamination.common.store, type(spark.sparkContext).broadcast

    def watched(*args):
        n, lists = blocks(*args)
        return n, (events.append("block") or x for x in lists)

    def kept(self, value):
        made = broadcast(self, value)
        destroy = made.destroy
        made.destroy = lambda *a: events.append("gone") or destroy(*a)
        return made

    monkeypatch.setattr(contamination, "_blocks", watched)
    monkeypatch.setattr(contamination.common, "store", lambda *a: events.append("stored") or store(*a))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", kept)
    got = contamination.scan(docs, bench, block_bytes=40)
    assert events == ["block", "stored", "gone"] * (events.count("block") - 1) + ["block"] and len(events) > 3
    assert {r["doc_id"]: r["items"] for r in got.collect()} == {1: ["9"], 2: []}


def test_hits_keep_their_place_in_the_original(spark):
    bench = spark.createDataFrame([(1, "über das MEER")], "item_id bigint, text string")
    text = "Ein Schiff fährt, (Über das - Meer)! Über das Meer."
    docs = spark.createDataFrame([(1, text.replace("Ü", "ü"))], "doc_id bigint, text string")
    r = contamination.scan(docs, bench).collect()[0]
    assert [text[a:b].lower() for a, b in zip(r["char_starts"], r["char_ends"])] == ["über das - meer)! über das meer"]
    assert (r["hit_starts"], r["hit_ends"], r["items"]) == ([3], [9], ["1"])


def test_dropping_keeps_rows_and_columns(spark, messy):
    bench = spark.createDataFrame([(1, "two rows of different ids")], "item_id bigint, text string")
    clean = contamination.drop_contaminated(messy, bench)
    assert clean.columns == messy.columns
    assert as_rows(clean, "doc_id", "text") == sorted((r for r in MESSY if r[0] not in (5, 6)), key=repr)
