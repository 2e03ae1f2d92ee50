"""The ten operators against brute force, held-out accuracy and exact round trips, and their edge cases.

Edge cases are the same for all that read documents: EDGES holds nulls in every column, empty and very long texts,
repeated rows and columns with clashing names.
"""

import itertools
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragraf.llm import chunks, decontam, embeddings, jaccard, langid, licenses, links, packing, quality, quotes, secretscan
from paragraf.llm.common import BROADCAST_ROWS, bounded_sample, narrow
from secret_lines import LINES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, _gone STRING, _of INT, _spans STRING, row STRING, m MAP<STRING, STRING>"
LONG = " ".join(f"wort{i % 9973} und" for i in range(60_000))
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [(None, "text ohne nummer hat keinen platz", "de"), (1, None, "de"), (2, "", None), (3, " \n\t ", "de"), (4, "...!!!", "xx"), (5, LONG, "de"), (6, prose(6, 80), "en"), (6, prose(6, 80), "en"), (7, prose(6, 80), None), (8, "wort", "de"), (9, "ä", None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", "z", {"k": "v"}) for i, t, lang in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def made(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id BIGINT, text STRING")


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


# 1


def test_language_accuracy_and_rejection(docs, spark):
    rows = docs.where("doc_id % 2 = 0")
    model = langid.fit(rows)
    found = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (found.lang == found.truth).mean() > 0.97
    odd = made(spark, [(1, "0x3f 9f8a 77 zq qzx jjj kkqq xxz 0001 1110"), (2, "")])
    assert [r.accepted for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [False, False]


def test_language_edges(spark, edges, empty):
    model = langid.fit(edges)
    rows = langid.identify(edges, model).collect()
    assert len(rows) == len(EDGES) - 1
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang is None and not by[i].accepted and by[i].probability == 0 for i in (1, 2))
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert all(r.lang is None for r in langid.identify(edges, None).collect())
    labelled = lambda rows: spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    # nothing to learn from: no subwords, one language, too few rows
    assert langid.fit(labelled([(i, " . ", lang) for i, lang in enumerate(["de", "en"] * 20)])) is None
    assert langid.fit(labelled([(i, f"wort {i}", "de") for i in range(40)])) is None
    assert langid.fit(labelled([(1, "wort", "de")])) is None


@pytest.mark.parametrize("rows", [10, 100])
def test_language_of_few_rows(docs, rows):
    few = docs.where(F.col("lang").isin("en", "de")).limit(rows)
    model = langid.fit(few)
    found = langid.identify(docs.where(F.col("lang").isin("en", "de")), model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (found.lang == found.truth).mean() > 0.95


def test_language_against_plain_loops(docs):
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.where("doc_id % 10 = 3").collect():
        b = langid._row_buckets(r.text)
        p = model.probabilities((sum(model.table[k].astype(float) for k in b) / len(b) + model.bias)[None])[0] if len(b) else None
        got = found[r.doc_id]
        assert got.lang == (model.langs[int(p.argmax())] if len(b) else None) and abs(got.probability - (p.max() if len(b) else 0)) < 1e-4


# 2


def test_quality_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    assert 0.5 <= model.prior <= 0.99
    found = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert found[found.quality == 1].keep.mean() > 0.97 and found[found.quality == 0].keep.mean() < 0.05
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).where("keep").collect()}


def test_quality_counts_all_documents(spark, docs):
    """The model is that of plain loops over all texts, however the table is cut; on 200 documents it tells the labelled ones."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model, again = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels)
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold
    rows = sorted((r.doc_id, r.fold, r.text) for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id), 5)").alias("fold"), "text").collect() if words(r.text))
    x = np.concatenate([quality.text_features([t]) for _, _, t in rows])
    folds, good = np.array([f for _, f, _ in rows]), {r.doc_id for r in labels.where("quality = 1").collect()}

    def gathered(keyed):
        sums = {}
        for k in range(len(x)):
            quality.add(sums, *keyed(x[k : k + 1], folds[k : k + 1]))
        return sums

    assert gathered(quality._moments)[0][0] == len(rows)
    mine = np.array([d in good for d, _, _ in rows])
    plain = quality.train(x[mine], folds[mine], gathered)
    assert abs(plain.weights - model.weights).max() < 1e-3 and abs(plain.threshold - model.threshold) < 1e-3
    found = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].keep.mean() > 0.97 and found[found.quality == 0].keep.mean() < 0.2


def test_quality_edges(spark, edges, empty, docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (8, 1, 0), (9, 1, 0), (None, 1, 1), (7, None, None)], "doc_id BIGINT, quality INT, toxic INT")
    model = quality.fit(edges, labels)
    by = {r.doc_id: r for r in quality.score(edges, model).collect()}
    assert all(by[i].score is None and not by[i].keep for i in (1, 2, 3, 4))
    assert quality.keep_good(edges, model).columns == edges.columns
    assert quality.fit(edges, labels.where("false")) is None and quality.fit(empty, labels) is None
    assert quality.fit(edges, labels.where("doc_id = 5")) is None
    assert {r.doc_id for r in quality.keep_good(edges, None).collect()} == {None, 5, 6, 7, 8, 9}
    assert quality.score(empty, model).count() == 0
    # rows that repeat a doc_id with other texts are answered each
    other = made(spark, [(1, "Ein ganz normaler Satz steht hier."), (1, "%%% ||| 00 %%% ||| 00")])
    assert len(quality.score(other, model).collect()) == 2


def test_prior_estimate():
    r = np.random.RandomState(0)
    p, n = r.randn(4000, 3) + [2, 0, 1], r.randn(3000, 3) - [2, 0, 1]
    u, folds = np.concatenate([p[1000:], n]), np.arange(7000) % 5

    def gathered(keyed):
        sums = {}
        quality.add(sums, *keyed(u, folds[: len(u)]))
        return sums

    model = quality.train(p[:1000], folds[:1000], gathered)
    assert 0.35 < model.prior < 0.65
    assert (model.score(n) < model.threshold).mean() > 0.9 and (model.score(p) >= model.threshold).mean() > 0.95


# 3


@pytest.fixture(scope="module")
def scanner():
    return secretscan.fit()


def test_secret_recall_on_other_findings(scanner):
    rows = secretscan.findings(1500, seed=99)
    p = scanner.probabilities([secretscan._encode(t, a, b) for t, _, a, b, _ in rows])
    said = p >= np.array([scanner.thresholds[k] for _, k, _, _, _ in rows])
    truth = np.array([y for *_, y in rows]) > 0
    assert said[truth].mean() > 0.97 and said[~truth].mean() < 0.1


def test_network_gradient():
    net = secretscan.Net(3)
    rows = secretscan.findings(6, seed=4)
    x, sizes = secretscan._batch([secretscan._encode(t, a, b) for t, _, a, b, _ in rows])
    y = np.array([r[4] for r in rows], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: np.logaddexp(0, np.where(y > 0, -1, 1) * net.forward(x, sizes)[0]).mean()
    g = net.gradients(x, sizes, y)
    for k, at in (("w", (2, int(x[0, 40]), 5)), ("c", (5,)), ("u", (7, 3)), ("v", (2,)), ("e", (0,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3


def test_secret_scan_and_redaction(spark, edges, empty, scanner):
    key = "ghp_" + "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"
    text = f"Vorher api_key = \"{key}\" nachher. " + LONG
    rows = made(spark, [(1, text), (1, text), (2, None), (3, ""), (None, f"token={key}"), (4, "harmlos: nichts")])
    found = secretscan.scan(rows, scanner).collect()
    assert [(r.doc_id, text[r.start : r.end]) for r in found] == [(1, key)] * 2
    out = secretscan.redact(rows.withColumn("n_chars", F.length("text")), scanner).collect()
    assert [key in (r.text or "") for r in out] == [False] * 6 and out[2].text is None
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in out)
    assert out[0].text == text.replace(key, "[SECRET]")
    assert secretscan.redact(edges, scanner).columns == edges.columns and secretscan.redact(edges, scanner).count() == len(EDGES)
    assert secretscan.scan(empty, scanner).count() == 0


def test_secret_values_are_candidates_whole():
    cases = [('password = "Pass1!"', "Pass1!"), ('password = "abc12!!!"', "abc12!!!"), ("password = Pass1! ", "Pass1!"), ('password: "Tr,9kd82xQ"', "Tr,9kd82xQ"), ("password: Tr,9kd82xQ ", "Tr,9kd82xQ"), ('pwd = "hunter22,xyz9!"', "hunter22,xyz9!"), ('passphrase = "correct horse battery staple"', "correct horse battery staple")]
    cases += [("https://h/?user=bob&password=hunter22&x=1", "hunter22"), ("postgres://app:hunter22@db", "hunter22"), ("redis://:hunter22@h:1/0", "hunter22"), ("-u app:hunter22@db", "hunter22"), ("password        =        hunter22", "hunter22"), ('{\\"password\\": \\"hunter 22\\"}', "hunter 22"), ("pw='it\\'s me'", "it\\'s me"), ("Authorization: Bearer abc123xyz", "abc123xyz"), ("password:p7#kHb*@9OpOin", "p7#kHb*@9OpOin")]
    for text, secret in cases:
        assert secret in [text[a:b] for _, a, b in secretscan.candidates(text)], text
    assert sum(b - a for _, a, b in secretscan.candidates("a=a=" * 20_000)) < 200_000


def test_secret_recall_on_planted_spans(scanner):
    rows = list(itertools.islice(secretscan.planted(99), 2000))
    found = secretscan._found(scanner, [t for t, *_ in rows])
    whole = [any(u <= a and b <= v for u, v, *_ in f) for (_, a, b, _), f in zip(rows, found)]
    truth = np.array([y for *_, y in rows]) > 0
    assert np.array(whole)[truth].mean() > 0.95 and np.array([bool(f) for f in found])[~truth].mean() < 0.1


def test_secrets_in_lines_written_by_hand(scanner):
    found = secretscan._found(scanner, [t for t, _ in LINES])
    hit = [any(a <= t.index(s) and t.index(s) + len(s) <= b for a, b, _, _ in f) for (t, s), f in zip(LINES, found) if s]
    false = [t for (t, s), f in zip(LINES, found) if not s and f]
    assert np.mean(hit) >= 0.9 and len(false) <= 3, ([t for (t, s), h in zip([x for x in LINES if x[1]], hit) if not h], false)


def plain_probability(model, text, a, b):
    """One candidate through the network, in loops over characters."""
    p, code = model.net.p, lambda c: int(secretscan._CODE[min(ord(c), 255)])
    at = lambda k: code(text[k]) if 0 <= k < len(text) and a - secretscan.BEFORE <= k < b + secretscan.AFTER else 0
    value = lambda k: np.maximum(sum(p["w"][j][at(k + j - secretscan.WIDTH // 2)] for j in range(secretscan.WIDTH)) + p["c"], 0)
    parts = [[value(k) for k in r] for r in (range(a - secretscan.BEFORE, a), range(a, b), range(b, b + secretscan.AFTER))]
    pooled = np.concatenate([*(np.max(x, 0) for x in parts), np.mean(parts[1], 0)])
    logit = np.maximum(pooled @ p["u"] + p["d"], 0) @ p["v"] + p["e"][0]
    return 1 / (1 + np.exp(-logit / model.temperature))


def test_secret_scores_against_plain_loops(spark, scanner):
    texts = [(d, t) for d, (t, _) in enumerate(LINES)]
    want = {}
    for d, t in texts:
        spans = [(a, b, plain_probability(scanner, t, a, b), k) for k, a, b in secretscan.candidates(t)]
        good = sorted((a, b, p) for a, b, p, k in spans if p >= scanner.thresholds[k])
        merged = []
        for a, b, p in good:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), max(p, merged[-1][2]))
            else:
                merged.append((a, b, p))
        want |= {(d, a, b): p for a, b, p in merged}
    got = {(r.doc_id, r.start, r.end): r.probability for r in secretscan.scan(made(spark, texts), scanner).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    tied = secretscan.scan(made(spark, [(1, LINES[0][0]), (2, LINES[0][0]), (2, LINES[1][0])]), scanner).collect()
    assert len(tied) == 3 and tied[0].digest == tied[1].digest


# 4


def test_conversations(spark):
    rows = [
        (1, 0, "a", "Hallo Welt\nzwei", 0), (1, 1, "b", "On Monday a wrote:\n> hallo   WELT\n> zwei\nJa", 0), (1, 2, "c", "> Ja\nNein", 0), (1, 3, "d", "> Hallo Welt\n> zwei\nAuch", 0),
        (2, 0, None, None, 0), (2, 1, "x", "", 0), (2, 1, "x", "", 0), (None, 1, "x", "weg", 0), (2, None, "x", "weg", 0), (3, 5, "x", "> nie gesagt\nfrei " + LONG, 0),
    ]
    found = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pos INT")).orderBy("conv_id", "reply_rank").collect()
    assert [(r.turn, r.text, r.parent_turn, r.depth) for r in found[:4]] == [(0, "Hallo Welt\nzwei", None, 0), (1, "Ja", 0, 1), (2, "Nein", 1, 2), (3, "Auch", 0, 1)]
    assert [(r.n_quotes, r.n_linked) for r in found[:4]] == [(0, 0), (1, 1), (1, 1), (1, 1)]
    assert [r.conv_id for r in found[4:]] == [2, 2, 2, 3] and [r.reply_rank for r in found[4:]] == [0, 1, 2, 0]
    assert (found[-1].n_quotes, found[-1].n_linked, found[-1].text[:4]) == (1, 0, "frei")
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).count() == 0


def test_long_conversations_are_ordered_alike(spark, monkeypatch):
    rows, r = [], random.Random(6)
    for c in range(6):
        said = []
        for t in range(r.choice([1, 9, 40])):
            own = prose(1000 * c + t, 6)
            quoted = "\n".join("> " + line for line in r.choice(said).split("\n")) + "\n" if said and r.random() < 0.6 else ""
            said.append(own + ("\nGruß" if t % 3 == 0 else ""))
            rows.append((c, t, "x" if t % 2 else None, quoted + said[-1]))
    table = spark.createDataFrame(rows + rows[:3], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    short = sorted(map(str, quotes.reply_ordered(table).collect()))
    monkeypatch.setattr(quotes, "STRETCH", 3)
    assert sorted(map(str, quotes.reply_ordered(table, local=2).collect())) == short and len(short) == len(rows) + 3


# 5


def weighted(ws, n=3):
    out = {}
    n = min(n, len(ws))
    for k in range(len(ws) - n + 1):
        g = tuple(ws[k : k + n])
        out[g] = out.get(g, 0) + 1
    return out


def window_similarity(a, b):
    size = lambda g: sum(len(w.encode()) for w in g)
    both = sum(min(c, b.get(g, 0)) * size(g) for g, c in a.items())
    return both / (sum(c * size(g) for g, c in a.items()) + sum(c * size(g) for g, c in b.items()) - both)


def brute_contamination(texts, items):
    found = {}
    for d, t in texts:
        ws = words(t)
        for i, item in items:
            iw = words(item)
            if ws and iw:
                n = min(len(iw), len(ws))
                values = [window_similarity(weighted(ws[s : s + n]), weighted(iw)) for s in range(len(ws) - n + 1)]
                if max(values) >= decontam.THRESHOLD:
                    found[d, i] = round(max(values), 6)
    return found


def test_decontamination_against_brute_force(spark):
    items = [(i, prose(1000 + i, 20 + 3 * i)) for i in range(8)]
    texts = [(d, prose(d, 120)) for d in range(30)]
    for d in range(30, 60):
        r = random.Random(d)
        ws = items[d % 8][1].split()
        for _ in range(r.choice([0, 1, 2, 4])):
            ws[r.randrange(len(ws))] = "anders"
        texts.append((d, prose(d, r.randrange(60)) + " " + " ".join(ws).upper() + " " + prose(d + 500, r.randrange(60))))
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(made(spark, texts), spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect()}
    want = brute_contamination(texts, items)
    assert set(found) <= set(want) and len(found) >= decontam.RECALL * len(want) - 1 and len(want) >= 15
    assert all(abs(found[k] - want[k]) < 1e-6 for k in found)
    passes = decontam.contaminated(made(spark, texts), spark.createDataFrame(items, "item_id BIGINT, text STRING"), items_per_pass=3)
    assert {(r.doc_id, r.item_id): r.similarity for r in passes.collect()} == found


def test_fingerprint_radius_meets_its_recall():
    """Pairs of windows at the threshold lie within the radius as often as stated."""
    r, t = np.random.RandomState(9), 0.6
    assert decontam.radius(1.0) == 0 and decontam.radius(0.3) > decontam.radius(0.6) > decontam.radius(0.9)
    within, n, shared = 0, 600, 90  # of 120 n-grams each, 90 in common: 90 / 150
    for _ in range(n):
        grams = r.randint(1, 1 << 62, 150).astype(np.uint64) * np.uint64(2)
        bits = decontam.signed_bits(grams, r.randint(12, 24, 150))
        a, b = (decontam.fingerprints(x.sum(0)[None])[0] for x in (bits[:120], np.concatenate([bits[:shared], bits[120:]])))
        within += sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b)) <= decontam.radius(t)
    assert within / n >= decontam.RECALL - 0.01


def test_multi_index_loses_nothing_within_the_radius():
    r = np.random.RandomState(8)
    c = decontam.Class(9, 3, 23)
    c.items = [(k, None, None, None, 0, p, np.array([k], np.uint64)) for k, p in enumerate(r.randint(0, 1 << 16, (50, 4)).astype(np.uint16))]
    c.close()
    prints = np.stack([x[5] for x in c.items])[r.randint(0, 50, 400)] ^ (1 << r.randint(0, 16, (400, 4))).astype(np.uint16) ^ (r.randint(0, 1 << 16, (400, 4)) & r.randint(0, 1 << 16, (400, 4)) & r.randint(0, 1 << 16, (400, 4))).astype(np.uint16)
    apart = np.array([[sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(p, q[5])) for q in c.items] for p in prints])
    assert set(zip(*(x.tolist() for x in c.candidates(prints, np.arange(50))))) == set(zip(*(x.tolist() for x in np.nonzero(apart <= 23))))
    assert (apart <= 23).sum() > 300


def test_decontamination_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, prose(6, 80)), (1, "zweiter text eines postens"), (2, None), (None, "x y z"), (3, ""), (4, "wort")], "item_id BIGINT, text STRING")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(edges, items).collect()} == {(6, 1), (7, 1), (8, 4)}
    kept = decontam.clean(edges, items)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 9}
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.clean(edges, items.where("false")).count() == len(EDGES)


# 6


def brute_chunks(raw):
    gear, at, out = chunks._GEAR.tolist(), 0, []
    for k in range(len(raw)):
        h = sum(gear[raw[k - j]] << j for j in range(chunks.WINDOW) if k - j >= 0) & 0xFFFF
        inside = k + 1 < len(raw) and (raw[k + 1] & 0xC0) == 0x80
        if k == len(raw) - 1 or (h >> (16 - chunks.BITS) == 0 and not inside and k >= chunks.WINDOW - 1):
            out.append((at, raw[at : k + 1]))
            at = k + 1
    return out


def brute_repeats(texts, min_bytes=chunks.MIN_BYTES):
    """Documents are distinct (doc_id, text); of those that share a doc_id the text's number orders them."""
    number = lambda t: int(chunks._text_numbers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), chunks.Words())[0])
    docs, first, holders, runs = sorted({(d, number(t), t) for d, t in texts if d is not None and t}), {}, {}, set()
    for d, n, t in docs:
        for _, c in brute_chunks(t.encode()):
            first.setdefault(c, (d, n))
            holders.setdefault(c, set()).add((d, n))
    for d, n, t in docs:
        merged = []
        for a, c in brute_chunks(t.encode()):
            if len(holders[c]) > 1 and first[c] != (d, n):
                if merged and merged[-1][1] == a:
                    merged[-1][1] = a + len(c)
                    merged[-1][2].add(c)
                else:
                    merged.append([a, a + len(c), {c}])
        runs |= {(d, a, b - a) for a, b, kinds in merged if sum(map(len, kinds)) >= min_bytes or b - a == len(t.encode())}
    return runs


def test_substring_dedup_against_brute_force(spark):
    shared = prose(77, 70) + " größer"
    texts = [(d, prose(d, 50) + " " + shared + " " + prose(d + 90, d)) for d in range(6)] + [(6, shared), (7, shared), (8, prose(8, 9)), (9, prose(8, 9))]
    texts += [(d, f"{prose(d, 30)} {'oder ' * 80} {prose(d + 1, 30)}") for d in (20, 22)] + [(30, prose(30, 60) + " " + prose(30, 60))]
    found = {(r.doc_id, r.start, r.n_bytes) for r in chunks.repeated(made(spark, texts)).collect()}
    # a short document that is a copy is found; a word said over and over, and what one document says twice, are not
    assert found == brute_repeats(texts) and {d for d, _, _ in found} == {1, 2, 3, 4, 5, 6, 7, 9}
    assert all(sum(n for e, _, n in found if e == d) > 0.8 * len(shared) for d in range(1, 8))
    out = {r.doc_id: r.text for r in chunks.without_repeats(made(spark, texts)).collect()}
    assert out[0] == texts[0][1] and out[8] == prose(8, 9) and out[7] == out[9] == ""


def test_substring_dedup_of_repeated_ids(spark):
    texts = [(1, "ä" * 150 + prose(1, 60)), (1, prose(2, 90)), (1, prose(2, 90)), (1, "ö" + prose(1, 60)), (2, prose(2, 90)), (1, prose(1, 60) + " Ende")]
    found = {(r.doc_id, r.start, r.n_bytes) for r in chunks.repeated(made(spark, texts)).collect()}
    assert found == brute_repeats(texts)
    out = sorted((r.doc_id, r.text) for r in chunks.without_repeats(made(spark, texts)).collect())
    assert len(out) == len(texts)
    kept = sum(len(t.encode()) for _, t in texts) - sum(len(t.encode()) for _, t in out)
    # the passage that the two equal rows share with a document before them goes from both, if it goes
    assert kept in (sum(n for *_, n in found), sum(n for *_, n in found) + max(n for *_, n in found))
    assert (2, "") in out and all("\ufffd" not in t for _, t in out)


def test_substring_dedup_edges(edges, empty):
    found = chunks.repeated(edges).collect()
    assert {r.doc_id for r in found} == {7}
    out = chunks.without_repeats(edges)
    assert out.columns == edges.columns and out.count() == len(EDGES) and chunks.repeated(empty).count() == 0
    assert chunks.without_repeats(empty).count() == 0


# 7


def brute_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, free in enumerate(bins) if free >= n]
        k = min(fits, key=lambda k: bins[k]) if fits else len(bins)
        if not fits:
            bins.append(capacity)
        bins[k] -= n
    return len(bins)


@pytest.mark.parametrize("capacity", [32, 50, 1])
def test_packing_against_best_fit(spark, capacity):
    texts = [(d, prose(d, random.Random(d).randrange(1, 70))) for d in range(120)] + [(5, "noch einer"), (900, "a")]
    texts += [(-(2**63) + 1, "weit unten"), (2**63 - 1, "weit oben"), *[(7, "gleich") for _ in range(30)]]
    rows = packing.pack(made(spark, texts).repartition(5), capacity).toPandas()
    totals = rows.groupby("doc_id").n_tokens.sum().to_dict()
    want = {}
    for d, t in texts:
        want[d] = want.get(d, 0) + len(t.split()) + 1
    assert totals == want
    used = rows.groupby("bin_id").n_tokens.sum()
    assert used.max() <= capacity and sorted(used.index) == list(range(len(used)))
    for _, b in rows.sort_values("bin_offset").groupby("bin_id"):
        assert list(b.bin_offset) == [0, *np.cumsum(b.n_tokens)[:-1]]
    assert len(used) == brute_bins(list(rows.n_tokens), capacity)


def test_packing_edges(edges, empty):
    rows = packing.pack(edges).toPandas()
    assert set(rows.doc_id) == {4, 5, 6, 7, 8, 9} and rows[rows.doc_id == 5].n_tokens.sum() == len(LONG.split()) + 1
    assert packing.pack(empty).count() == 0


# 8


def brute_classes(ids, x, threshold):
    """(id, class, links) of rows by comparing all with all."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    least = np.array(ids)
    for _ in ids:
        least = np.minimum(least, np.where(near, least, 1 << 40).min(1))
    return sorted(zip(ids, least.tolist(), near.sum(1).tolist()))


@pytest.mark.parametrize("tile", [16, 1024])
def test_embeddings_against_brute_force(spark, tile):
    r = np.random.RandomState(1)
    x = r.randn(300, 24)
    x[100:160] = x[:60] + 0.1 * r.randn(60, 24)
    x[200:205] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(7, [float(v) for v in x[7]])]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (905, [None] * 24), (906, [float("inf")] * 24)]
    others = [(904, [1.0] * 3), (907, [2.0] * 3), (908, [1.0, 0.0, 0.0]), (None, rows[0][1])]
    table = spark.createDataFrame(rows + bad + others, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("tile", F.lit(1))
    want = brute_classes([i for i, _ in rows], np.array([v for _, v in rows]), 0.9) + [(904, 904, 1), (907, 904, 1), (908, 908, 0)] + [(i, i, 0) for i, _ in bad]
    assert sorted(tuple(p) for p in embeddings.near_duplicates(table, 0.9, tile).collect()) == sorted(want)
    assert embeddings.near_duplicates(table.where("false")).count() == 0
    assert [tuple(p) for p in embeddings.near_duplicates(table.where("vec_id = 1")).collect()] == [(1, 1, 0)]


def test_embeddings_that_are_all_equal(spark):
    same = spark.range(900).select(F.col("id").alias("vec_id"), F.array(*[F.lit(2.0)] * 5).alias("embedding"))
    found = embeddings.near_duplicates(same, tile=64)
    assert found.count() == 900 and found.where("class_id = 0 AND n_links = 899").count() == 900


def test_embeddings_take_disk_by_the_vector_not_by_the_pair_of_tiles(spark, monkeypatch):
    r = np.random.RandomState(3)
    x = r.randn(1500, 24).astype(np.float32)
    x[1000:] = x[:500] + 0.3 * r.randn(500, 24)
    monkeypatch.setattr(embeddings, "CHUNK_BYTES", x.nbytes // 3, raising=False)  # several passes
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.length() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))
    sizes, over = [held()], threading.Event()

    def watch():
        while not over.wait(0.02):
            sizes.append(held())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = sorted(tuple(p) for p in embeddings.near_duplicates(table, 0.5, 16).collect())
    finally:
        over.set()
        watcher.join()
    assert max(sizes) - sizes[0] < 8 * x.nbytes + 1_000_000  # shuffled tiles of all pairs would take far more
    assert found == sorted(brute_classes(range(len(x)), x.astype(float), 0.5))


def test_tiles_never_lose_a_pair():
    r = np.random.RandomState(2)
    x = r.randn(200, 40) * np.geomspace(4, 0.1, 40)
    x[100:] = x[:100] + 0.2 * r.randn(100, 40) * np.geomspace(4, 0.1, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embeddings.tile_pairs(x, x, 0.9)
    assert {*zip(*np.nonzero(x @ x.T >= 0.9))} <= {*zip(i, j)}


# 9


def gram_set(t):
    ws = words(t)
    return {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else ({tuple(ws)} if ws else set())


def brute_jaccard(texts, threshold=jaccard.THRESHOLD):
    """doc_id -> (class, links) by comparing all with all."""
    sets, links = {d: gram_set(t) for d, t in texts}, {d: 0 for d, _ in texts}
    edges, ids = [], sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                edges.append((a, b))
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    root = brute_roots(ids, edges)
    return {d: (root[d], links[d]) for d in ids}


def brute_roots(ids, edges):
    root, old = {d: d for d in ids}, None
    while root != old:
        old = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def near_copies():
    texts = [(d, prose(d, 60)) for d in range(40)]
    for d in range(40, 160):
        r = random.Random(d)
        ws = prose(d % 12, 60).split()
        for _ in range(r.randrange(5)):
            ws[r.randrange(60)] = "neu" + str(r.randrange(3))
        texts.append((d, " ".join(ws)))
    return texts


@pytest.mark.parametrize("block", [4, jaccard.BLOCK])
def test_jaccard_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard.linked, "__defaults__", (*jaccard.linked.__defaults__[:3], block))
    texts = near_copies() + [(200, prose(3, 60)), (201, prose(3, 60)), (202, ""), (203, "...")]
    rows = jaccard.jaccard_join(made(spark, texts + texts[40:60])).collect()
    found, want = {r.doc_id: (r.class_id, r.n_links) for r in rows}, brute_jaccard(texts)
    assert len(rows) == len(texts) and set(found) == set(want)
    n, m = sum(x for _, x in found.values()), sum(x for _, x in want.values())
    assert 0.98 * m <= n <= m and m > 1000 and all(found[d][1] <= want[d][1] for d in want)
    assert sum(found[d][0] == want[d][0] for d in want) >= 0.98 * len(want)
    kept = {r.doc_id for r in jaccard.keep_one(made(spark, texts)).collect()}
    assert kept == {d for d, (c, _) in found.items() if c == d}


def test_jaccard_of_repeated_ids(spark):
    texts = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(2, 60)), (2, prose(2, 60)), (3, prose(2, 60)), (3, None), (3, None), (4, prose(4, 60)), (4, prose(5, 60))]
    rows = sorted(tuple(r) for r in jaccard.jaccard_join(made(spark, texts)).collect())
    assert rows == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1), (3, 3, 0), (4, 4, 0), (4, 4, 0)]
    kept = sorted((r.doc_id, r.text or "") for r in jaccard.keep_one(made(spark, texts)).collect())
    assert kept == sorted([(1, prose(1, 60)), (2, prose(2, 60)), (3, ""), (3, ""), (4, prose(4, 60)), (4, prose(5, 60))])


def test_common_counts_what_sets_share():
    r = np.random.RandomState(5)
    sets = [np.unique(r.randint(0, 500, n)).astype(np.uint64) for n in (0, 1, 30, 200, 400, 7, 90)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.common(sets, width=64)
    assert all(got[i, j] == want[i][j] for i in range(7) for j in range(7) if i != j)


def test_bands_meet_the_recall():
    for t in (0.3, 0.5, 0.7, 0.9):
        bands, rows = jaccard.choose_bands(t, 0.99, 256)
        assert 1 - (1 - t**rows) ** bands >= 0.99 and bands * rows <= 256


@pytest.mark.parametrize("local", [0, links.LOCAL_EDGES])
def test_components(spark, local):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    root = brute_roots({i for e in edges for i in e}, edges)
    rows = spark.createDataFrame([(a, 0, 0, b, 0, 0) for a, b in edges], "a BIGINT, ax INT, ay INT, b BIGINT, bx INT, by INT")
    found = {x.node.id: x.root.id for x in links.components(rows.select(links.node("a", "ax", "ay").alias("u"), links.node("b", "bx", "by").alias("v")), local).collect()}
    assert found == {i: v for i, v in root.items() if i != v}
    assert links.components(rows.where("false").select(links.node("a", "ax", "ay").alias("u"), links.node("b", "bx", "by").alias("v")), local).count() == 0


def test_jaccard_edges(edges, empty):
    rows = sorted(tuple(r) for r in jaccard.jaccard_join(edges).collect())
    assert rows == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0)]
    kept = jaccard.keep_one(edges)
    assert kept.columns == edges.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 9]
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


# 10


def test_licenses(spark, edges, empty):
    lines = {d: text for d, (_, text) in enumerate(licenses.TEMPLATES)}
    texts = [(d, prose(d, 40 * d) + "\n" + t.upper() + ".\n" + prose(d + 50, 30)) for d, t in lines.items()]
    found = {}
    for r in licenses.license_scan(made(spark, texts + [(0, texts[0][1]), (99, prose(99, 3000)), (98, None), (97, "")])).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert set(found) == set(lines) and all(licenses.TEMPLATES[d][0] in found[d] for d in lines)
    # GPL versions are rivals: the one that is there is told
    assert found[5] == {"GPL-3.0"} and found[7] == {"GPL-2.0"}
    assert licenses.license_scan(edges).count() == 0 and licenses.license_scan(empty).count() == 0


def test_licenses_are_told_apart(spark):
    free = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [("Licensed under the MIT License", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0")]
    cases += [("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0")]
    cases += [("This program " + free.format("General Public License", 2), "GPL-2.0"), ("This library " + free.format("Lesser General Public License", 2.1), "LGPL-2.1"), ("This program " + free.format("Affero General Public License", 3), "AGPL-3.0"), ("This program " + free.format("General Public License", 3), "GPL-3.0")]
    cases += [(t, license) for license, t in licenses.TEMPLATES if license != "BSD"]
    found = {}
    for r in licenses.license_scan(made(spark, [(d, f"{prose(d, 50)}\n{t}\n{prose(d + 1, 50)}") for d, (t, _) in enumerate(cases)])).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    wrong = {t: found.get(d) for d, (t, license) in enumerate(cases) if found.get(d, set()) - ({"BSD"} if "Redistribution" in t else set()) != {license}}
    assert not wrong
    rivals = licenses.families(licenses.index(licenses.TEMPLATES, 2, 0.8, 0.999), 0.8)
    assert len({rivals[x] for x in ("MIT", "Apache-2.0", "MPL-2.0", "EPL-2.0", "ISC", "GPL-2.0", "BSD", "CC-BY-4.0", "CC-BY-3.0", "CC0-1.0")}) == 10


def brute_licenses(texts):
    """(doc_id, license) -> (containment, first word of the window) by looking at all windows of all templates."""
    grams = lambda ws: {tuple(ws[k : k + 2]) for k in range(len(ws) - 1)}
    family, best = licenses.families(licenses.index(licenses.TEMPLATES, licenses.N, licenses.THRESHOLD, licenses.RECALL), licenses.THRESHOLD), {}
    for d, t in texts:
        ws, own = words(t), {}
        for license, template in licenses.TEMPLATES:
            g, size = grams(words(template)), licenses.window_size(len(words(template)))
            for s in range(0, len(ws), size // 2):
                c = len(g & grams(ws[s : s + size])) / len(g)
                if c >= licenses.THRESHOLD:
                    own[license] = max(own.get(license, (0, 0)), (c, -s))
        for license, (c, s) in own.items():
            if c == max(x for k, (x, _) in own.items() if family[k] == family[license]):
                best[d, license] = round(c, 6), -s
    return best


def test_licenses_against_brute_force(spark):
    r, texts = random.Random(4), []
    for d in range(60):
        ws = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            ws[r.randrange(len(ws))] = "anders"
        texts.append((d, f"{prose(d, r.randrange(150))} {' '.join(ws)} {prose(d + 100, r.randrange(80))}"))
    texts += [(60, licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[0][1]), (61, licenses.TEMPLATES[0][1]), (61, prose(1, 9) + " " + licenses.TEMPLATES[0][1]), (61, licenses.TEMPLATES[0][1])]
    found = {(x.doc_id, x.license): (x.containment, x.window_word) for x in licenses.license_scan(made(spark, texts)).collect()}
    want = brute_licenses(texts[:61])
    assert {k: v for k, v in found.items() if k[0] < 61} == want and len(want) > 40
    # a doc_id that repeats is told once, with the best of its windows
    assert found[61, "Apache-2.0"] == (1.0, 0)


def test_license_bands_retrieve():
    for grams, size in ((3, 8), (12, 32), (45, 128)):
        n = licenses.bands(grams, size, 0.8, 0.999)
        least = 0.8 * grams / (grams + size - 1 - 0.8 * grams)
        assert 1 - (1 - least) ** n >= 0.999


# What they share


def test_bounded_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    a = bounded_sample(rows, "k", 100).collect()
    assert len(a) == 100 and a == bounded_sample(rows.repartition(7), "k", 100).collect()
    assert bounded_sample(rows.where("k < 30"), "k", 100).count() == 30
    assert bounded_sample(spark.range(3000).select(F.lit(None).cast("bigint").alias("k")), "k", 10).count() == 0


def test_broadcast_is_checked(spark):
    rows = spark.range(50)
    hinted = lambda df: "Broadcast" in df._jdf.queryExecution().toString() or "strategy=broadcast" in df._jdf.queryExecution().toString()
    assert hinted(narrow(rows, limit=50)) and not hinted(narrow(rows, limit=49))
    assert not hinted(narrow(rows, F.lit(10), limit=499)) and BROADCAST_ROWS == 1_000_000


def test_a_pass_of_tiles_is_short(spark):
    """20 MB of tiles take several passes, so that no task compares its tiles with all of them."""
    packed = spark.range(5).selectExpr("int(id) AS tile", "double(id) AS low", "double(id) AS high", "cast(repeat('x', 4 << 20) AS BINARY) AS raw")
    assert [tiles for _, _, tiles in embeddings._chunks(packed)] == [[0, 1], [2, 3], [4]]
