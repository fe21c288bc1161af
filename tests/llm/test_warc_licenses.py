"""WARC round trips and licence rules."""

import base64
import gzip
import hashlib
import random
import re
import textwrap

from pyspark.sql import functions as F

from flowspark.llm import licenses, warc

ROWS = [
    (1, "http://a.com/x?y", "<p>é"), (2, "http://a.com/2", "<p>é"), (3, None, None), (4, "nourl", ""), (5, "http://b/\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (None, "http://n/", "<p>é"), (None, "http://n/", "<p>é"), (2, "http://a.com/2", "<p>é"), (7, "http://z", "\r\n\r\n"), (8, "http://z", "a" * 3_000_000),
]


def pages(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_query_on_odd_rows(spark, tmp_path):
    got = warc.op1_warc_transactions(spark, pages(spark, tmp_path, ROWS)).collect()
    assert len(got) == len(ROWS)
    tops = {}
    for i, _, h in ROWS:
        tops[h or ""] = max(tops.get(h or "", -1), i if i is not None else -1)
    want, stored = [], set()
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        data = (h or "").encode()
        first = tops[h or ""] == i and h not in stored
        stored |= {h} if first else set()
        want.append((i or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", 0 if first else tops[h or ""]))
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(want)


def test_empty_table(spark, tmp_path):
    assert warc.op1_warc_transactions(spark, pages(spark, tmp_path, [])).count() == 0


def test_assembled_captures_hold_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(df, folder, revisit_bytes=5)
    out = warc.assemble(warc.read_archives(spark, folder)).collect()
    assert len(out) == len(ROWS) and all(r.request and r.metadata for r in out)
    by_page = {r.page_id: r for r in out if r.page_id is not None}
    assert bytes(by_page[5].response.payload) == ROWS[4][2].encode()
    assert by_page[5].target_uri == "http://b/%0D%0AX: y"
    assert by_page[3].kind == by_page[4].kind == "response"  # shorter than revisit_bytes
    assert by_page[1].kind == "revisit" and by_page[1].response.payload is None
    assert all(r.response.stated_digest == r.response.payload_digest for r in out if r.kind == "response")


def test_parts_that_miss(spark):
    schema = warc.RECORDS
    rows = [("<a>", "request", ["<gone>"], None, None, None, None, None, None, None), ("<b>", "response", None, None, "u", None, None, 1, None, bytearray(b"x"))]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got["<gone>"].kind is None and got["<gone>"].request and got["<gone>"].response is None
    assert got["<b>"].request is None and got["<b>"].response.payload_bytes == 1


MIT = " ".join(licenses.SENTENCES[i] for i in (3, 4, 5))


def test_license_rules(spark):
    wrapped = MIT.replace(" ", "\n", 400)
    rows = [
        (1, "Words.\nReleased under the MIT License."), (2, f"Intro text\n{MIT}"), (3, wrapped), (4, None), (5, ""), (6, "no licence here"),
        (7, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (8, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!"), (9, licenses.SENTENCES[5]),
        (10, "x. " * 20_000 + "Licensed under CC BY 4.0."), (1, "Words.\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].licenses == ["MIT"] and got[1].sentence_ids == "<1>"
    assert got[2].licenses == ["MIT"] and got[2].sentence_ids == "<3><4><5>"
    assert got[3].licenses == ["MIT"] and got[3].n_known == 3
    assert got[4].licenses == got[5].licenses == got[6].licenses == []
    assert got[7].licenses == ["CC-BY-NC-4.0"] * 2
    assert got[8].licenses == ["Apache-2.0"]
    assert got[9].licenses == [] and got[9].n_known == 1  # a sentence that no rule names by itself
    assert got[10].licenses == ["CC-BY-4.0"]
    assert licenses.scan_licenses(df).count() == len(rows) and licenses.scan_licenses(df.limit(0)).count() == 0


def test_every_sentence_and_rule_is_found(spark):
    wrap = lambda s: "\n\n".join("\n".join(textwrap.wrap(p, 64, break_long_words=False, break_on_hyphens=False)) for p in s.split("\n\n"))
    rows = [((i,), s) for i, s in licenses.SENTENCES.items()]
    rows += [(ids, "\n\n".join(licenses.SENTENCES[i] for i in ids)) for _, ids in licenses.RULES]
    texts = [(ids, text) for ids, s in rows for text in (s, wrap(s), f"Words before.\n\n{s}\n\nWords after.")]
    texts.append(((), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. SPDX-License-Identifier: Made-Up-9"))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    named = {ids: name for name, ids in reversed(licenses.RULES)}
    for k, (ids, text) in enumerate(texts):
        assert got[k].sentence_ids == "".join(f"<{i}>" for i in ids) and got[k].n_known == len(ids), text
        assert ids not in named or got[k].licenses == [named[ids]], text


def test_both_readings_count_at_each_place(spark):
    wrap = lambda s, n=50: "\n".join(textwrap.wrap(s, n))
    known = licenses.SENTENCES
    listed = lambda marks: "\n".join([known[21], *[f"{m} {wrap(known[i])}" for m, i in zip(marks, (22, 23, 24))]])
    rows = [
        ("<16><3><4><5>", ["MIT", "CC-BY-4.0"], "About\nLicensed under CC BY 4.0.\n" + wrap(MIT)),
        ("<25><?><3><4><5>", ["MIT", "MIT"], "// SPDX-License-Identifier: MIT\n// Copyright someone\n" + wrap(MIT)),
        ("<21><22><23><24>", ["BSD-3-Clause"], listed(("1.", "2.", "3."))), ("<21><22><23><24>", ["BSD-3-Clause"], listed(("1)", "(2)", "3)"))),
        ("<21><22><23><24>", ["BSD-3-Clause"], listed("***")), ("<21><22><23>", ["BSD-2-Clause"], "\r\n".join(f"{k}.\r\n\r\n{known[21 + k]}" for k in range(3))),
        ("<1><?><1>", ["MIT", "MIT"], f"{known[1]}\nThis isn't known\n{known[1]}"), ("<7>", ["Apache-2.0"], wrap(known[7])),
        ("", [], "Not released under the MIT License. Licensed under CC BY 4.0 or so."), ("<1>", ["MIT"], "1 " * 50_000 + ".\n" * 50_000 + known[1]),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "doc_id long, text string")).collect()}
    for k, (ids, found, text) in enumerate(rows):
        assert (got[k].sentence_ids, got[k].licenses) == (ids, found), text[:300]


def test_every_known_sentence_holds_a_clue_in_one_word():
    for s in licenses.SENTENCES.values():
        assert any(c in w for c in licenses.clues() for w in licenses.normal_form(s).split()), s
        assert len(licenses.normal_form(s).split()) >= licenses.KEY_WORDS


def plain_sequence(text):
    """Known sentences by trying each at each unit, longest first, with and without units that have no letters."""
    low = (text or "").translate(str.maketrans(licenses._UPPER, licenses._LOWER))
    low = re.sub(r"(?m)^[ \t]*\(?[0-9]{1,3}\)[ \t]+", "", low)
    units = [u for u in (re.sub("[^a-z0-9]+", " ", x).strip() for x in re.split(r"[.!?:][ \t\r\n]+|\n", low)) if u]
    letters = [any("a" <= c <= "z" for c in u) for u in units]
    known = {licenses.normal_form(s): i for i, s in licenses.SENTENCES.items()}
    hits = []
    for i in range(len(units)):
        for drop in (False, True):
            joined = ""
            for j in range(i, len(units)):
                if drop and not letters[j]:
                    if j == i:
                        break
                    continue
                joined = f"{joined} {units[j]}".strip()
                if joined in known:
                    hits.append((i, -(j + 1), known[joined]))
                if len(joined) > 700:
                    break
    out, last = "", 0
    for i, end, k in sorted(hits):
        if i >= last:
            out += ("<?>" if out and any(letters[last:i]) else "") + f"<{k}>"
            last = -end
    return out


def test_sequences_like_plain_python(spark):
    rng = random.Random(3)
    known = list(licenses.SENTENCES.values())
    texts = [None, "", "1. 2. 3."]
    for i in range(150):
        parts = [rng.choice([rng.choice(known), "Some words here.", "1.", "(2)", "the license", "See the License for", "Copyright 2020 A. B.", "\n"]) for _ in range(rng.randint(1, 9))]
        text = rng.choice([" ", "\n", "\n\n"]).join(parts)
        if i % 3 == 0:
            text = "\n".join(textwrap.wrap(text, rng.choice((1, 12, 40, 70)), break_long_words=False, break_on_hyphens=False))
        texts.append(text if i % 5 else text.upper())
    texts += ["\n".join(s.split()) for s in known] + ["WITHOUT ANY\nWARRANTY".join(known[13].split("WITHOUT ANY WARRANTY")), "AS\nIS".join(known[4].split("AS IS"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].sentence_ids == plain_sequence(t), t
    assert sum(r.n_known > 0 for r in got.values()) > 100


def test_long_known_lists_join_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(1, MIT), (1, MIT), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    few = sorted(map(str, licenses.scan_licenses(df).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_SENTENCES", 0)
    assert sorted(map(str, licenses.scan_licenses(df).collect())) == few


def test_parts_are_whole_records(spark):
    """Two metadata records of one response give the fields of one of them; a record may name several captures."""
    none = (None, None, None)
    rows = [
        ("<c>", "response", ["<d>"], *none, None, 1, None, bytearray(b"x")), ("<d>", "response", [], *none, None, 1, None, bytearray(b"y")),
        ("<m1>", "metadata", ["<c>"], *none, 5, None, None, None), ("<m2>", "metadata", ["<c>"], *none, 1, None, None, None), ("<m2>", "metadata", ["<c>"], *none, 1, None, None, None),
        ("<q>", "request", ["<c>", "<d>", "<c>"], *none, None, None, None, None),
    ]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert set(got) == {"<c>", "<d>"}
    assert got["<c>"].metadata.asDict() == {"record_id": "<m1>", "page_id": 5} and got["<c>"].page_id == 5
    assert got["<c>"].request.record_id == got["<d>"].request.record_id == "<q>" and got["<d>"].metadata is None
    head = "WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <q>\r\nWARC-Concurrent-To: <c>\r\nWARC-Concurrent-To: <d>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert next(warc.parse_archive(gzip.compress(head.encode())))["concurrent_to"] == ["<c>", "<d>"]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (1000, 30_000))
    rows = [(i, f"http://h/{i}", ("x" * (500 if i % 3 else 20_000)) + str(i)) for i in range(300)] + [(900 + i, "u", "y" * 200_000 + str(i)) for i in range(3)]
    folder = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "archives").glob("*.gz")]
    assert max(sizes) <= 300_000 and len(sizes) < 60
    assert warc.read_archives(spark, folder).count() == 3 * len(rows)


def test_a_page_repeated_many_times(spark, tmp_path):
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://a/").alias("url"), F.lit("<p>same").alias("html"))
    df.union(spark.createDataFrame([(8, "http://b/", "<p>same"), (6, None, "alone"), (6, "http://c/", "alone")], "page_id long, url string, html string")).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op1_warc_transactions(spark, str(tmp_path)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0, r["count"]) for r in got) == [(6, "response", 0, 1), (6, "revisit", 6, 1), (7, "revisit", 8, 100_000), (8, "response", 0, 1)]


def test_payloads_are_reduced_before_they_move(spark):
    rows = [(i, "u", f"p{i % 4}") for i in range(40)] + [(None, "u", "p1"), (50, "u", "alone"), (51, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    stored, revisits = warc.stored_captures(df), warc.revisit_captures(df)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan
    assert sorted(r.page_id for r in stored.collect()) == [36, 37, 38, 39, 50, 51]
    assert revisits.count() == len(rows) - 6 and {r.top for r in revisits.collect()} == {36, 37, 38, 39}
    assert "payload" not in revisits.columns
