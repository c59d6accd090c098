"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontam, elias_fano, html_extract, license_scan, lm, near_dedup, pii, quality, textcore, topk, url_filter
from tidewell.llm.components import components
from tidewell.llm.queries import tokenizer_path
from tidewell.llm.textcore import shingle_sets, words_of

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def awkward(spark, clash="score text"):
    """Nulls, empty, blank, very long, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, None, 1), (2, "", 2), (3, " \n\t ", 3), (None, "some words of a text here", 4), (5, "a b", 5), (5, "a b", 5), (6, "x" * 300_000, 6), (7, "word " * 50_000, 7), (8, "Ünïcödé \u0301 \U0001f600 \x00 a@b.co", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long").withColumns({c: F.lit(None).cast("string") for c in clash.split() if c != "text"})


def test_clashing_names_whatever_their_case(spark):
    docs = spark.createDataFrame([(1, "joe@example.com", "a", "b", 3)], "doc_id long, text string, Score string, SPANS string, N_Tokens long")
    model = quality.CompressionModel(constant=0.25)
    for out, made in (
        (quality.score_texts(docs, model), {"score": 0.25}),
        (pii.scan_pii(docs, add=("spans",)), {"spans": "email:0:15"}),
        (bpe.encode_texts(docs, tokenizer_path(), add=("n_tokens",)), {"n_tokens": len(bpe.encoder(tokenizer_path()).encode("joe@example.com"))}),
    ):
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        assert {k: out.first()[k] for k in made} == made
    page = spark.createDataFrame([("<p>x</p>", "a", 9)], "html string, Text string, N_Chars long")
    assert html_extract.extract_text(page).columns == ["html", "text", "n_chars"]


def test_shared_folder_is_never_local_on_a_cluster():
    class Context:
        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def master(self):
            return "spark://host:7077"

    import types

    session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(_jsc=types.SimpleNamespace(sc=Context)), conf={})
    with pytest.raises(ValueError):
        textcore.shared_folder(session)


# Words and shingles.


def test_word_hashes_match_words():
    texts = ["a b", "", None, " A b c\x1c\n d ", "x" * 3_000_000 + " y", "a b"]
    w = words_of(pa.array(texts))
    assert [b - a for a, b in zip(w.first, w.first[1:])] == [len(words(t)) for t in texts]
    assert w.hashes[0] == w.hashes[2] and w.hashes[0] != w.hashes[1]
    assert [len(s) for s in shingle_sets(words_of(pa.array(["a b c a b c a b", "b a", None])), 3)] == [3, 1, 0]


# 1. Near duplicates.


def brute_components(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(rng, groups=6, copies=12):
    docs, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            docs.append((n, " ".join(w)))
            n += 1
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("broadcast_rows, levels", [(500_000, 1), (0, 3)])
def test_near_duplicates_match_brute_force(spark, broadcast_rows, levels, monkeypatch):
    """Lists of more than a few entries get pivots, those of their differences too."""
    for name, value in (("FREQUENT", 4), ("SHORT", 3), ("CROWD", 3), ("LEVELS", levels)):
        monkeypatch.setattr(near_dedup, name, value)
    docs = near_copies(random.Random(3))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, broadcast_rows=broadcast_rows).collect()}
    assert got == brute_components(docs, 4, 80)


def test_near_duplicates_at_the_limit_in_a_large_group(spark):
    """Texts that hold a group's base and add 25%, with many of their own values among the smallest."""
    rng, base = random.Random(8), [f"b{k}" for k in range(403)]
    docs = [(0, " ".join(base)), *((k, " ".join([*base, *(f"v{k}x{j}" for j in range(10))])) for k in range(1, 101))]
    (start,) = shingle_sets(words_of(pa.array([docs[0][1]])), 4)
    while len(docs) < 107:
        text = " ".join([*base, *(f"o{rng.randrange(10**9)}" for _ in range(100))])
        (found,) = shingle_sets(words_of(pa.array([text])), 4)
        if len(found) == 500 and len(np.setdiff1d(found[:64], start)) >= 20:
            docs.append((len(docs), text))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs, 4, 80) and {c for _, c in got.values()} == {0}


def test_near_duplicates_in_a_crowd(spark):
    """One text, variants from close to just too far, extensions and cuts of it, and texts that share a passage: default constants."""
    rng, base = random.Random(4), [f"b{k}" for k in range(160)]
    passage, docs = [f"p{k}" for k in range(60)], [" ".join(base)]
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        cut = rng.randrange(40)
        docs.append(" ".join(rng.choice([w, w, w + [f"e{rng.randrange(10**6)}" for _ in range(cut)], w[cut:], w[cut // 2 : len(w) - cut // 2]])))
    for _ in range(120):
        docs.append(" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))]))
    for text in rng.sample(docs, 60):  # one word changed in what may be far from all others
        w = text.split()
        w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    rng.shuffle(docs)
    want = brute_components(list(enumerate(docs)), 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) > 20


def test_near_duplicate_estimates():
    rng = np.random.default_rng(5)
    sketches = [np.sort(rng.choice(2**40, n, replace=False).astype(np.uint64) << np.uint64(24)) for n in (0, 1, 5, 64, 64)]
    pairs = [(a, b) for a in sketches for b in sketches] + [(sketches[3], np.sort(np.concatenate([sketches[3][:40], sketches[4][:24]])))]
    lists = [pa.array([p[k].view(np.int64) for p in pairs], pa.list_(pa.int64())) for k in (0, 1)]
    for (a, b), got in zip(pairs, near_dedup.estimates(*lists)):
        union = sorted(set(a.tolist()) | set(b.tolist()))[: near_dedup.SKETCH]
        assert got == (sum(x in a and x in b for x in union) / len(union) if union else 0)


def test_near_duplicate_keys_needed():
    for percent in (50, 80, 100):
        needed = near_dedup.keys_needed(percent)
        # Sets within their sketches: at most so many are in one alone.
        assert all(needed[n] == n + 1 - -(-percent * n // 100) for n in range(1, percent * near_dedup.SKETCH // 100 + 1))
        k = needed[-1]
        tail = sum(math.comb(64, x) * (percent / 100) ** x * (1 - percent / 100) ** (64 - x) for x in range(0, 64 - k + 1))
        assert tail <= near_dedup.MISS and max(needed) == k


def test_near_duplicates_awkward(spark):
    rows = near_dedup.near_duplicates(awkward(spark, "component_id kept")).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[5]["n_shingles"] == 1
    assert by[None]["component_id"] is None and all(r["kept"] for r in rows)
    assert near_dedup.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


# 2. Quality.


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit_labelled(docs, labels.where(~held))
    rows = quality.score_texts(docs.join(labels.select("doc_id", "quality"), "doc_id").where(held), model).collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good) and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_the_difference_alone():
    """Held-out accuracy whatever the order of the sample, and a score by hand."""
    import pandas as pd
    import zstandard

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    every = docs[["doc_id", "text"]].merge(labels[["doc_id", "quality"]], on="doc_id")
    held = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in every["doc_id"]])
    text = np.array([t.encode() for t in every["text"]], dtype=object)
    y, y_test = every["quality"].to_numpy()[~held], every["quality"].to_numpy()[held]
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(y))
        model = quality.fit([t for t in text[~held][order] if len(t) < 1 << 16], [q for q, t in zip(y[order], text[~held][order]) if len(t) < 1 << 16])
        score = model.scores(text[held])
        rank = pd.Series(score).rank().to_numpy()
        good = y_test == 1
        assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) >= 0.99
        assert ((score >= 0.3) == good).mean() >= 0.96 and (score[good] >= 0.3).mean() >= 0.985
    assert (np.diff(model.heights) >= 0).all() and (np.diff(model.knots) >= 0).all()
    t = b"some text to be measured by hand " * 40
    sizes = [[len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(t[k : k + 256])) for k in range(0, len(t), 256)] for d in (model.bad, model.good)]
    total = sum(min(a - b, 0.05 * len(t[256 * k : 256 * k + 256])) for k, (a, b) in enumerate(zip(*sizes)))
    assert model.scores([t])[0] == np.interp((total + 64 * model.prior) / (len(t) + 64), model.knots, model.heights)


def test_quality_monotone_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 30, 60).astype(float), rng.integers(0, 2, 60).astype(float)
        knots, heights = quality.monotone_fit(x, y, np.ones(60))
        # Isotonic regression over the distinct x as the largest of smallest means.
        values = np.unique(x)
        means = [max(min(y[(x >= values[a]) & (x <= values[b])].mean() for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]
        assert len(knots) == 2 * len(set(np.round(means, 9))) and (np.diff(heights) >= 0).all() and 0 < heights[0] and heights[-1] < 1


def test_quality_awkward(spark):
    model = quality.fit([b"good prose about things " * k for k in range(1, 40)] + [b"$$$ ### " * k for k in range(1, 40)], [1] * 39 + [0] * 39)
    rows = quality.score_texts(awkward(spark, "score predicted"), model).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["n"]: r["score"] for r in rows}
    assert by[1] == by[2]
    assert quality.fit([], []).constant == 0.5 and quality.fit([b"x"], [1]).constant == 1.0
    assert quality.score_texts(awkward(spark).limit(0), model).count() == 0


# 3. Top k.


def test_topk_block_matches_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, d = rng.integers(1, 400), rng.integers(1, 9)
        m = rng.integers(-30, 30, (n, d)).astype(np.int16) if trial % 2 else (rng.normal(size=(n, d)) * 100).astype(np.int16)
        if trial % 3 == 0:
            m[rng.integers(0, n, n // 2)] = m[0]  # many ties, and a gap that ends the search early
        ids = rng.permutation(n * 2)[:n].astype(np.int64)
        own = ids[:1]
        ((got, scores),) = topk.ImpactBlock(ids, m).search(m[:1], 5, own)
        exact = m.astype(np.int64) @ m[0].astype(np.int64)
        order = [k for k in np.lexsort((ids, -exact)) if ids[k] != own[0]][:5]
        assert got.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()


def test_topk_stops_on_proof():
    """With a few heavy dimensions searches end before the last level, and floors pass over whole blocks."""
    rng = np.random.default_rng(7)
    m = (rng.normal(size=(3000, 24)) * np.array([2000.0] * 3 + [5.0] * 21)).astype(np.int16)
    ids, q = np.arange(3000), m[:40]
    block = topk.ImpactBlock(ids, m)
    exact = m.astype(np.int64) @ q.astype(np.int64).T
    for (got, scores), e, own in zip(block.search(q, 5, ids[:40]), exact.T, range(40)):
        order = [k for k in np.lexsort((ids, -e)) if k != own][:5]
        assert got.tolist() == order and scores.tolist() == e[order].tolist()
    assert np.mean(np.array(block.levels_left) > 0) > 0.5 and len(set(block.levels_left)) > 3
    high = exact.max(axis=0) + 1
    reach = (np.maximum(q.astype(np.int64) * block.low, q.astype(np.int64) * block.high)).sum(axis=1)
    assert all(not len(got) for got, _ in block.search(q, 5, ids[:40], reach + 1))
    assert all((scores < h).all() for (_, scores), h in zip(block.search(q, 5, ids[:40], high), high))


def test_topk_table(spark):
    rows = [(k, [float(x) for x in np.random.default_rng(k).normal(size=4)]) for k in range(60)]
    rows += [(60, None), (61, [1.0, None, 1.0, 1.0]), (62, [float("nan")] * 4), (63, [float("inf")] * 4), (64, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 5, block_rows=16, query_rows=2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v in rows[:60]}
    assert sorted(got) == [0, 20, 40]
    for k, found in got.items():
        every = sorted(((-int(q[k] @ q[c]), c) for c in [*q, 7] if c != k))[:5]
        assert sorted(found) == [(n, c, -s) for n, (s, c) in enumerate(every, 1)]
    assert topk.top_k(df.limit(0), df, 5).count() == 0


# 4. Personal data.


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(pii.Span(m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s.start, pii.BASE_KINDS.index(s.kind)))


def test_pii_base_matches_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("a.@-+%_ 1234567890().12é") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find_spans(t) if s.kind in pii.BASE_KINDS] == brute_spans(t), t
    long = "1" * 200_000 + " " + "a" * 200_000 + "@" + "b.c" * 1000
    assert pii.find_spans(long)[-1].kind == "email"


def test_pii_rows(spark):
    t = 'mail joe.x@mail.example.com or +1 (377) 555-0100, ip 10.0.0.1, card 4111 1111 1111 1111, token = "abc123def456"'
    assert [s.kind for s in pii.find_spans(t)] == ["email", "phone", "ip", "card", "account"]
    assert pii.redact(t, pii.find_spans(t)) == 'mail <EMAIL> or <PHONE>, ip <IP>, card <CARD>, token = "<ACCOUNT>"'
    rows = pii.scan_pii(awkward(spark, "spans n_ip")).collect()
    by = {r["n"]: r for r in rows}
    assert len(rows) == 9 and by[1]["redacted"] is None and by[2]["redacted"] == "" and by[8]["n_email"] == 1
    assert by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan_pii(awkward(spark).limit(0)).count() == 0


def test_pii_cues_in_any_case():
    secret = "Ab1_" * 50
    for cue in pii.CUES:
        for word in (cue, cue.upper(), cue.capitalize()):
            for after in (" = ", ": '", " ID=", "_Number: "):
                for before in ("", "İK \U0001f600 "):
                    t = f"{before}{word}{after}{secret} end"
                    at = t.index(secret)
                    assert pii.joined(pii.find_spans(t)) == f"account:{at}:{at + len(secret)}", t
    for scheme in pii.SCHEMES:
        t = f"see {scheme.upper()}Joe@example.com/x now"
        assert pii.Span(4, len(t) - 4, "address") in pii.find_spans(t)
    assert not pii.find_spans("TO\u212aEN = abc123def456") and not pii.find_spans("token = abc12")
    assert pii.redact("API_KEY=abc123def456", pii.find_spans("API_KEY=abc123def456")) == "API_KEY=<ACCOUNT>"


def brute_added(text):
    """Added spans by trying every place, cue and end."""
    out, free, low = [], {"address": 0, "account": 0}, text.translate(LOWER)
    for at in range(len(text)):
        hits = [(len(w), k, w) for k, ws in (("address", pii.SCHEMES), ("account", pii.CUES)) for w in ws if low.startswith(w, at)]
        for size, kind, word in sorted(hits):
            if at < free[kind]:
                continue
            rest = text[at + size :]
            if kind == "address":
                m = re.match(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]+(:[0-9]+)?[^\s<>\"']*", rest)
                if m:
                    free[kind] = at + size + m.end()
                    out.append(pii.Span(at, free[kind], kind))
                continue
            m = re.match(r"([ _-]?([iI][dD]|[nN][oO]|[nN][uU][mM][bB][eE][rR]|[kK][eE][yY]))?[ ]{0,3}[:=#][ ]{0,3}[\"']?", rest)
            if not m:
                continue
            body, ends = rest[m.end() :], []
            if word == "iban":
                for n in range(1, min(len(body), 50) + 1):
                    flat = re.sub("[ -]", "", body[:n])
                    grouped = re.fullmatch(r"[A-Za-z]{2}[0-9]{2}([ -]?[A-Za-z0-9]{4}){2,7}([ -]?[A-Za-z0-9]{1,3})?", body[:n])
                    if grouped and not body[n : n + 1].isalnum() and 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                        ends = [n]
            if not ends and word in ("iban", "account", "ssn", "passport"):
                ends = [n for n in range(1, len(body) + 1) if re.fullmatch(r"[0-9]{2,}([ -][0-9]{2,})+", body[:n]) and not re.match("[A-Za-z0-9]", body[n:])][-1:]
                ends = [n for n in ends if len(re.sub("[ -]", "", body[:n])) >= 8]
            if not ends:
                run = re.match(r"[A-Za-z0-9_-]*", body)[0]
                ends = [len(run)] if len(run) >= 8 and sum(c.isdigit() for c in run) >= 2 else []
            if ends:
                free[kind] = at + size + m.end() + ends[0]
                out.append(pii.Span(at + size + m.end(), free[kind], kind))
    return sorted(out, key=lambda s: (s.start, pii.KINDS.index(s.kind)))


def test_pii_added_spans_match_brute_force():
    rng = random.Random(2)
    parts = [*pii.CUES, *pii.SCHEMES, "IBAN", "Account No", ": ", "=", " = '", "#", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "123-45-6789", "1234 5678 90", "abc123def", "12", " ", "joe@example.com", "bob:pw", "@", "host.com:80/x", "x", "-", "\n", "9876543210123"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [s for s in pii.find_spans(t) if s.kind not in pii.BASE_KINDS] == brute_added(t), t
    t = "IBAN: DE89 3704 0044 0532 0130 00 and Account No: 1234 5678 9012."
    assert pii.redact(t, [s for s in pii.find_spans(t) if s.kind == "account"]) == "IBAN: <ACCOUNT> and Account No: <ACCOUNT>."
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")


# 5. BPE.


@pytest.fixture(scope="module")
def coder():
    return bpe.TreeBpe(tokenizer_path())


def test_bpe_matches_library(coder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    texts = ["", "x <|startoftext|> y<|endoftext|>", "İstanbul ΣΑΣ ½²³ e\u0301", "a\x85b\xa0c\x1cd"]
    texts += ["".join(rng.choice("abcdE'stre lmdvÉéΣσς1²½!?#\u0301\x85\x1c\xa0\n<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("athinger") for _ in range(rng.randint(60, 3000))) for _ in range(25)]
    texts += ["aB" + chr(c) + "c" + chr(c) + " 1" + chr(c) + "'" for c in range(0, 0x3000, 7)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        n, joined, decoded = coder.digest_parts(t)
        assert (n, joined) == (len(ids), " ".join(map(str, ids))) and decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_leaves_and_heap_agree(coder, monkeypatch):
    rng = random.Random(9)
    words_ = ["".join(rng.choice("athinger" if k % 2 else "aab") for _ in range(rng.randint(1, 60))) for k in range(600)]
    leaves = [coder.word(w) for w in words_]
    monkeypatch.setattr(bpe, "LEAF", 1)
    assert [coder.word(w) for w in words_] == leaves


def test_bpe_batches_match_library(coder):
    """Texts of all kinds in one batch, words at each other's edges, words longer than a leaf."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(11)
    texts = [None, "", " ", "'", "'s", "x'", "''s 's't'll'l 're'r 'v've1'd'D'M!'t \"'s é's\x1c's", "\x00", "<|endoftext|>", "a<|endoftext|>'s<|startoftext|> ", "ab" * 40, "ǅȺȾİ", "ɏ", "ɐ", "\U0001f600's"]
    texts += ["".join(rng.choice("'" * 5 + "strevmldDLSTRE 1½é!\x85\n" + ("Σ́" if k % 9 == 0 else "")) for _ in range(rng.randint(0, 30))) for k in range(3000)]
    texts += ["<|endoftext|>".join(rng.choice(["", " ", "It's", "Σ"]) for _ in range(rng.randint(2, 6))) for _ in range(50)]
    texts += ["".join(rng.choice("athinger " + "é" * (k % 2)) for _ in range(rng.randint(0, 400))) for k in range(60)]
    for t, (n, joined, decoded) in zip(texts, coder.all_digest_parts(texts), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (n, joined) == (len(ids), " ".join(map(str, ids))) and decoded == library.decode(ids, skip_special_tokens=False), t
    assert coder.all_digest_parts([]) == []


def test_bpe_distinct_words_are_merged_together():
    """A text of new words takes less than half the time of its words one by one."""
    import time

    rng = random.Random(2)
    words_ = list({"".join(rng.choice(["th", "in", "er", "tion", "an", "qu", "é"]) for _ in range(rng.randint(3, 8))) for _ in range(30_000)})
    fresh = bpe.TreeBpe(tokenizer_path())
    at = [time.process_time()]
    n = fresh.digest_parts(" ".join(words_))[0]
    at.append(time.process_time())
    assert n == sum(len(fresh.word(w)) for w in words_)
    at.append(time.process_time())
    assert 2 * (at[1] - at[0]) < at[2] - at[1]


def test_bpe_tables_start_anew():
    small = bpe.TreeBpe(tokenizer_path(), table_entries=50)
    texts = [" ".join(f"word{k}x{j}" for j in range(30)) for k in range(10)]
    fresh = bpe.TreeBpe(tokenizer_path())
    assert [small.digest_parts(t) for t in texts] == [fresh.digest_parts(t) for t in texts]


def test_bpe_pieces_join_exactly(coder):
    rng = random.Random(5)
    for n in range(150):
        t = "".join(rng.choice("abcdE'stre lmdvÉéΣ1²½!?\u0301\n" + "the " * 4 + ("a" * 60 if n % 3 == 0 else "")) for _ in range(rng.randint(30, 900)))
        pieces = [coder.piece(x) for x in bpe.cut(t, rng.randint(5, 60))]
        assert coder.join_all(pieces).ids.tolist() == coder.encode(t)


def test_bpe_rows(spark, coder):
    df = awkward(spark, "n_tokens ids")
    short = {r["n"]: r for r in bpe.encode_texts(df, tokenizer_path()).collect()}
    cut = {r["n"]: r for r in bpe.encode_texts(df, tokenizer_path(), long_text=1000).collect()}
    assert short == cut and len(bpe.encode_texts(df, tokenizer_path(), long_text=1000).collect()) == 9
    assert short[1]["n_tokens"] == 0 and short[1]["decoded"] == "" and short[7]["n_tokens"] == 50_000
    assert bpe.encode_texts(df.limit(0), tokenizer_path()).count() == 0
    marked = [(k, ("<|endoftext|>" * (k % 3) + "some text " * 40 + "<|startoftext|>" + "x" * 300) * 3) for k in range(6)]
    rows = bpe.encode_texts(spark.createDataFrame(marked, "k int, text string"), tokenizer_path(), long_text=100)
    assert {r["k"]: r["ids"] for r in rows.collect()} == {k: coder.encode(t) for k, t in marked}


def test_bpe_long_texts_are_dealt_out(spark):
    """Pieces of one long text are encoded in several tasks."""
    df = spark.createDataFrame([("word " * 2000,)], "text string")
    spark.sparkContext.setJobGroup("bpe pieces", "")
    bpe.encode_texts(df, tokenizer_path(), add=("n_tokens",), long_text=100).collect()
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("bpe pieces") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setJobGroup("", "")
    assert tasks.count(int(spark.conf.get("spark.sql.shuffle.partitions"))) >= 1


# 6. HTML.


def test_html_labels_unseen_pages():
    net = html_extract.trained()
    rng = random.Random(99)
    wrong = total = 0
    for _ in range(120):
        page, labels = html_extract.sample_page(rng)
        blocks = html_extract.blocks_of(page)
        assert len(blocks) == len(labels)
        wrong += int((net.label(html_extract.features([blocks]))[0] != np.array(labels)).sum())
        total += len(labels)
    assert wrong <= 0.01 * total


def test_html_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.BlockLabeller({k: v.astype(np.float64) for k, v in html_extract.trained().weights.items()})
    x = rng.normal(size=(4, 3, html_extract.FEATURES))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    target = rng.integers(0, 2, (4, 3)).astype(float)
    _, grads = net.gradients(x, mask, target)
    for name, at in (("fw", (3, 5)), ("ru", (2, 7)), ("out", (4,)), ("fb", (9,))):
        keep = net.weights[name][at]
        both = []
        for step in (1e-4, -1e-4):
            net.weights[name][at] = keep + step
            both.append(net.gradients(x, mask, target)[0])
        net.weights[name][at] = keep
        assert abs((both[0] - both[1]) / 2e-4 - grads[name][at]) < 1e-3


def test_html_given_pages(spark):
    import html as entities

    rows = html_extract.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in rows:
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_html_telling_word_after_many_classes():
    """A mark counts wherever it stands among the classes of a tag."""
    many = " ".join(f"col-md-{k}" for k in range(9))
    (path, *_), *_ = html_extract.blocks_of(f'<body><div class="{many} sidebar"><p>text</p></div></body>')
    assert any(".sidebar" in marks for marks in path)


def test_html_awkward(spark):
    pages = [(1, None), (2, ""), (3, "<"), (4, "<article><p>A &amp; B<!-- x --> <b>c</b><br>d<p>e</article>"), (4, "<article><p>A &amp; B<!-- x --> <b>c</b><br>d<p>e</article>"), (5, "<script>" + "x" * 100_000), (6, "<div>" * 3000 + "deep")]
    rows = html_extract.extract_text(spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == 7 and [r["text"] for r in rows if r["page_id"] == 4] == ["A & B c d\ne"] * 2 and rows[0]["text"] == ""


# 7. Language model.


def test_elias_fano():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, top = rng.integers(0, 300), int(rng.integers(1, 10 ** int(rng.integers(1, 15))))
        v = np.sort(rng.integers(0, top, n))
        e = elias_fano.EliasFano.build(v, top)
        x = rng.integers(0, top, 50)
        low = rng.integers(0, n + 1, 50)
        high = np.array([rng.integers(k, n + 1) for k in low])
        if n:
            assert e.successor(x, low, high).tolist() == [int(a + np.searchsorted(v[a:b], y)) for y, a, b in zip(x, low, high)]
        assert (e.access(np.arange(n)).astype(np.int64) == v).all() and (e.successor(x) == np.searchsorted(v, x)).all()


def test_trie_is_memory_mapped(tmp_path):
    code = np.unique(np.random.default_rng(2).integers(0, 50, 900) * (1 << 32) + np.random.default_rng(3).integers(0, 100, 900))
    c, w, p = code >> 32, code & 0xFFFFFFFF, np.random.default_rng(4).random(len(code)) + 1e-9
    (tmp_path / "trie").write_bytes(elias_fano.NgramTrie.build(c, w, p).to_bytes())
    trie = elias_fano.NgramTrie.open(str(tmp_path / "trie"))
    assert (trie.codes_of(c, w) == elias_fano.quantise(p)).all() and trie.successors_of(int(c[0]))[0].tolist() == w[c == c[0]].tolist()
    assert (trie.codes_of(np.array([10**6, 3]), np.array([1, 10**6])) == 0).all()
    # Every context with every word: only its own successors are found, within its pointers.
    pairs, known = [(a, b) for a in range(51) for b in range(101)], dict(zip(zip(c.tolist(), w.tolist()), elias_fano.quantise(p).tolist()))
    assert lm.mapped(trie.to_bytes()).codes_of(*map(np.array, zip(*pairs))).tolist() == [known.get(x, 0) for x in pairs]
    assert np.abs(np.log10(elias_fano.dequantise(elias_fano.quantise(p))) - np.log10(p)).max() < 2e-4


def test_lm_matches_brute_force(spark, monkeypatch):
    for name, value in (("BATCH_CHARS", 20_000), ("WORDS_PER_SHARD", 500), ("BIGRAMS_PER_SHARD", 3000), ("CONTEXT_PER_SHARD", 50)):
        monkeypatch.setattr(lm, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 10]
    single = collections.Counter(x for k in train for x in tokens[k])
    pairs = collections.Counter(p for k in train for p in zip(["<s>", *tokens[k][:-1]], tokens[k]))
    total, distinct = sum(single.values()), len(single)
    context = {**single, "<s>": len(train)}
    for k, w in tokens.items():
        base = [(single[x] + 0.1) / (total + 0.1 * (distinct + 1)) for x in w]
        model = [(pairs[c, x] + lm.MU * p) / (context.get(c, 0) + lm.MU) for c, x, p in zip(["<s>", *w[:-1]], w, base)]
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in single for x in w), total, zlib.crc32(str(k).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(map(math.log10, base)), rel_tol=1e-9)
        assert abs(r["score"] - sum(map(math.log10, model))) < 2e-4 * len(w)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_awkward(spark):
    rows = lm.score_texts(awkward(spark, "score held_out")).collect()
    assert len(rows) == 9 and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert lm.score_texts(awkward(spark).limit(0)).count() == 0


# 8. URL filters.


def glob_fits(glob, text):
    """By the places in text that each prefix of glob reaches; a backtracking pattern takes exponential time on many stars."""
    reached = {0}
    for c in glob:
        reached = set(range(min(reached), len(text) + 1)) if c == "*" and reached else {i + 1 for i in reached if text[i : i + 1] == c}
    return len(text) in reached


def test_glob_automaton():
    rng = random.Random(2)
    globs = ["*", "", "a*b", "*ab*ba*", "**a", "ab", "a*" * 40 + "b", *("".join(rng.choice("ab*") for _ in range(rng.randint(1, 9))) for _ in range(40))]
    texts = ["", "a", "ab", "é*", *("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200))]
    found = url_filter.GlobAutomaton(globs).matches(pa.array([*texts, None]))
    for k, t in enumerate([*texts, ""]):
        assert found[k].tolist() == [glob_fits(g, t) for g in globs]


def test_glob_automaton_over_many_words():
    """The registered rules and globs take more than four words of bits, and hundreds of globs many more."""
    globs = [r.glob for r in url_filter.RULES] + list(url_filter.BLOCK_GLOBS)
    assert url_filter.GlobAutomaton(globs).words > 4
    rng = random.Random(11)
    many = ["".join(rng.choice("abc*") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    automaton = url_filter.GlobAutomaton(many)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    assert automaton.words > 20
    got = automaton.matches(pa.array(texts))
    for glob, column in zip(many, got.T):
        pattern = re.compile(re.sub(r"(\.\*)+", ".*", ".*".join(map(re.escape, glob.split("*")))), re.S)
        assert column.tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob


def test_url_rules(spark):
    urls = [None, "x", "http://A.ORG/es/\x1f?x", "http://x.com?http://z/en/", "https://foo.org/x.com/en/", "a://com/en/", "://xcom/en/", "http://u.example.com/en/7a", "http://a.casino-x.de/", "http://example.net/de/81", "http://b.net/de/8", "http://q.org#/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.org", "/es/\x1f", "org/es/", "block"), 3: ("x.com", "", None, "allow"), 4: ("foo.org", "/x.com/en/", None, "allow"), 5: ("com", "/en/", "com/en/", "block"),
        6: ("xcom", "/en/", None, "allow"), 7: ("u.example.com", "/en/7a", "example.com/en/7", "allow"), 8: ("a.casino-x.de", "/", None, "block"), 9: ("example.net", "/de/81", "example.net/de/8", "block"), 10: ("b.net", "/de/8", "net/de/", "allow"), 11: ("q.org", "", None, "allow"),
    }
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# 9. Decontamination.


def brute_leaks(docs, items, size=5, least=0.8):
    bag = lambda w: collections.Counter([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)])
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            n, best = min(len(v), len(w)), None
            for s in range(len(w) - n + 1) if n else ():
                a, b = bag(w[s : s + n]), bag(v)
                alike = sum((a & b).values()) / sum((a | b).values())
                if alike >= least and (best is None or alike > best[0]):
                    best = (alike, s, n)
            if best:
                out[d, i] = best
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(8)] + [(8, None)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if d % 2:
            x = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, 2)):
                if x:
                    x[rng.randrange(len(x))] = "zz"
            w[(k := rng.randint(0, len(w))) : k] = x
        docs.append((d, " ".join(w).upper() if d % 3 else " ".join(w)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (4_000_000, 150):
        rows = decontam.find_leaks(a, b, block_chars=block_chars).collect()
        assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"], r["n_words"]) for r in rows} == brute_leaks(docs, items)


def test_decontamination_radius():
    index = decontam.ItemIndex(list(range(30)), [" ".join(f"a{k}x{j}" for j in range(20)) for k in range(30)], 5)
    rng = np.random.default_rng(1)
    prints = np.concatenate([index.prints ^ np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in range(30)], dtype=np.uint64) for n in range(0, decontam.RADIUS + 1)])
    who, item = index.within(20, prints)
    close = {(w, i) for w in range(len(prints)) for i in range(30) if int(prints[w] ^ index.prints[i]).bit_count() <= decontam.RADIUS}
    assert set(zip(who.tolist(), item.tolist())) == close


def test_decontamination_awkward(spark):
    items = spark.createDataFrame([(1, "some words of a text here"), (2, None), (3, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(awkward(spark, "similarity"), items).collect()] == [(None, 1)]
    left = decontam.clean(awkward(spark, "similarity"), items)  # a row with a null key is judged by its text
    assert left.columns == ["doc_id", "text", "n", "similarity"] and sorted(r["n"] for r in left.collect()) == [1, 2, 3, 5, 5, 6, 7, 8]
    assert decontam.clean(awkward(spark), items.limit(0)).count() == 9 and decontam.clean(awkward(spark).limit(0), items).count() == 0
    assert decontam.find_leaks(awkward(spark).limit(0), items).count() == 0 == decontam.find_leaks(awkward(spark), items.limit(0)).count()


# 10. Licences.


def test_license_cues_are_lossless():
    assert all(any(c in w for w in s.split() for c in license_scan.CUES) for s in license_scan.sentence_table())


def test_license_rules(spark):
    t = license_scan.TEXT_SENTENCES
    texts = ["Code.\nLicensed under the  Apache License, Version 2.0 !", "\n".join([t["mit-grant"], t["mit-notice"], t["mit-as-is"]]), "\n".join([t["bsd-grant"], t["bsd-source"], t["bsd-binary"], t["bsd-endorse"]]), "\n".join([t["bsd-grant"], t["bsd-source"], t["bsd-binary"]]), "ALL RIGHTS RESERVED. Released under CC BY-SA 4.0.", "unlicensed prose"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["licenses"] for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()] == ["Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-SA-4.0,all-rights-reserved", ""]
    rows = license_scan.scan_licenses(awkward(spark, "licenses n_sentences")).collect()
    assert len(rows) == 9 and {r["licenses"] for r in rows} == {""} and license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_sentences_end_to_end(spark):
    names = license_scan.licence_names()
    granted = [(grant.format(name) + end, f"grant-{x}") for x in names for name in names[x] for grant in license_scan.GRANTS for end in ("", ' (the "License");')]
    wanted = [*granted, *((text, key) for key, text in license_scan.TEXT_SENTENCES.items())]
    assert len(wanted) > 2500
    forms = (lambda t: t, lambda t: "Prose. " + t + " Prose", lambda t: "Prose\r\n" + textwrap.fill(t, 72).replace("\n", "\r\n") + "\r\nprose", lambda t: "/*\n" + textwrap.fill(t, 72, initial_indent=" * ", subsequent_indent=" * ") + "\n */", lambda t: textwrap.fill(t, 20, initial_indent="# ", subsequent_indent="# "))
    rows = [(k, form(text), key) for k, (text, key) in enumerate(wanted) for form in forms if form is not forms[1] or text[-1] in ".;:"]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, wanted string")).where("sentence_ids <> wanted or n_sentences <> 1").collect()
    assert not got, got[:5]


def test_license_headers(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n' + textwrap.fill(license_scan.TEXT_SENTENCES["apache-as-is"], 72)
    gpl, gpl2 = (textwrap.fill(license_scan.TEXT_SENTENCES[k], 72) + "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of" for k in ("gpl-free", "gpl2-free"))
    texts = [apache, gpl, gpl2, textwrap.fill(license_scan.TEXT_SENTENCES["mpl-terms"], 40), "// SPDX-License-Identifier: MIT\nint x;", "Name: x\nLicense: BSD-3-Clause\nVersion: 1", "Licensed under the\n\nMIT License", "licence: " + ". " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.scan_licenses(df).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == ["Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "MPL-2.0", "MIT", "BSD-3-Clause", "", ""]
    assert rows[0]["sentence_ids"] == "grant-Apache-2.0,apache-compliance,apache-copy,apache-as-is"


def test_license_scan_is_native(spark):
    plan = license_scan.scan_licenses(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
