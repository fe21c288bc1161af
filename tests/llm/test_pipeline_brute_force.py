"""The corpus pipeline against plain versions of its five stages, on documents with nulls, copies, repeats and junk."""

import hashlib
import random
import re
from types import SimpleNamespace

import public_tokenizers
from test_near_duplicates import classes
from test_quality_classifier_pipeline import DOCS, plain_em, plain_judge, plain_scores, plain_votes, statistics, table
from test_slots_mixing_urls_topk import quantile
from tokenizers import Tokenizer

import corpus_pipeline
from flowspark.llm import mixing, quality, weak_labels


def documents():
    rows = [(r[0], r[1][:600], r[2], "src" + str(r[0] % 4), 1) for r in table(90, 21)]
    near = lambda i, k, word: (k, " ".join(w if n != 10 else word for n, w in enumerate(rows[i][1].split())), *rows[i][2:])
    rows += [near(4, 1004, "changed"), near(4, 1005, "other"), near(7, 3, "earlier"), (1006, rows[8][1], rows[8][2], "src1", 1)]
    rows += [rows[11]] * 3  # repeated rows
    rows += [(2000, None, "en", "src0", None), (None, rows[12][1] + " one more", "en", "src2", 5), (None, None, None, None, None), (2001, "", "en", "src0", 0), (2002, rows[13][1] + " x", None, None, 1)]
    random.Random(4).shuffle(rows)
    return rows


def by_rules(rows):
    found = []
    for _, text, lang, source, _ in rows:
        n_words, word_chars, n_symbols, n_dup, n_repeat = statistics(text)
        n_lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        capitals = sum(c in quality.CAPITALS for c in text or "")
        failed = n_words < quality.MIN_WORDS or 100 * n_repeat > quality.MAX_REPEAT_PERCENT * n_words
        found.append(SimpleNamespace(n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup, n_repeat_words=n_repeat, n_lines=n_lines, n_capitals=capitals, lang=lang, source=source, base_failed=failed))
    distance = plain_judge(found)
    return [r for i, r in enumerate(rows) if i in distance and distance[i] <= quality.CUTOFF]


def by_classifier(rows):
    scores = plain_scores([r[1] for r in rows], plain_em([plain_votes(r[1]) for r in rows]))
    return [r for r, s in zip(rows, scores) if s >= weak_labels.KEEP]


def one_of_each(rows):
    first = lambda g: min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    return [rows[first(g)] for g in classes([r[:2] for r in rows])]


def copies(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode())
    weight = {s: mixing.TARGET_WEIGHTS.get(s, 1.0) for s in size}
    total, all_ = sum(size.values()), sum(w for s, w in weight.items() if size[s])
    out = []
    for r in rows:
        rate = weight[r[3]] * total / all_ / size[r[3]] if size[r[3]] else 1.0
        parts = max(1, -(-rate // mixing.PART_MEAN))
        name = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        for j in range(1, int(parts) + 1):
            u = int(hashlib.md5(f"{name}:{mixing.SEED}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            out += [r] * quantile(rate / parts, u)
    return out


def test_pipeline_like_plain_stages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(weak_labels, "ROUNDS", 20)
    monkeypatch.setattr(weak_labels.train, "__defaults__", (20,))
    rows = documents()
    spark.createDataFrame([(*r, True, 1.0) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    stages = [by_rules(rows)]
    for stage in (by_classifier, one_of_each, copies):
        stages.append(stage(stages[-1]))
    assert len(rows) > len(stages[0]) > 0 and len(stages[1]) > len(stages[2])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in stages[-1]:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0] if r[0] is not None else -1, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:3], stages):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
        assert sorted(map(key, docs.collect())) == sorted(map(key, kept)), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
