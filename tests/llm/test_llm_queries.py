"""Corpus queries against SQL, the libraries themselves, or a brute-force version."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.oracle import connect, differences
from vertexflow.llm import catalog, secrets

SF = "/root/testdata/sf0.01"
QUERIES = catalog.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return {d: t or "" for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(con, QUERIES[name](spark, SF), catalog.oracle_sql()[name]) == (0, 0)


def test_token_counts_are_the_librarys(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        n = len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def _windows(scanner, t, taken):
    """Model spans by trying all windows of all runs, one after the other."""
    letters, out = " " + secrets.ALPHABET, []

    def best(s, e):
        found = None
        for a in range(s, e):
            total = 0.0
            for b in range(a, e):
                total += scanner.ratios[letters.index(t[b - 1]) if b > run else 0, letters.index(t[b])]
                if b + 1 - a >= secrets.WINDOW and total >= scanner.threshold and (found is None or total > found[0] + 1e-9):
                    found = total, a, b + 1
        if found:
            _, a, b = found
            yield a, b
            yield from best(s, a)
            yield from best(b, e)

    for m in re.finditer(r"[A-Za-z0-9+/=_.-]{8,}", t):
        run = m.start()
        gains = sum(max(0.0, scanner.ratios[letters.index(t[i - 1]) if i > run else 0, letters.index(t[i])]) for i in range(*m.span()))
        if gains >= scanner.threshold:
            out += [(a, b) for a, b in best(*m.span()) if not any(a < e and s < b for s, e in taken)]
    return out


def test_secret_spans(spark, docs):
    import hashlib

    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    total, scanner = 0, secrets.Scanner(secrets.default_samples())
    for r in QUERIES["op3_secret_scan"](spark, SF).collect():
        t = docs[r.doc_id]
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        more = _windows(scanner, t, [(s, e) for s, _, _, e in spans])
        assert r.n_markov == len(more)
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted([*spans, *((s, 3, "markov", e) for s, e in more)]))
        total += len(spans)
    assert total


def test_packing_keeps_every_token_and_is_tight(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, SF).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        ids = np.array([*tok.encode(docs[d], add_special_tokens=False).ids, 0], "<u4")
        expected = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(own) == expected
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(n for own in bins.values() for _, n in own)
    assert len(bins) <= math.ceil(total / 2048) * 1.01 + 1


def test_search_recall_and_scores(spark, con):
    table = con.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([t[0] for t in table]), np.array([t[1] for t in table], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(dict)
    for r in QUERIES["op8_nearest"](spark, SF).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    queries = np.flatnonzero(ids % 50 == 0)
    hits = 0
    for q in queries:
        cos = unit @ unit[q]
        cos[q] = -2
        own = found[ids[q]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        assert all(abs(cos[ids == v][0] - s) < 1e-12 for v, s in own.values())
        assert [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in own.values()} & set(ids[np.argsort(-cos)[:5]]))
    assert hits / (5 * len(queries)) >= 0.9


def test_quality_on_held_out_labels(spark, con, docs):
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op9_quality"](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in apart) / len(apart) > 0.97


def test_language_model_against_brute_force(spark, docs):
    from vertexflow.llm import language_model as lm

    tokens = {d: [*words(t), None] for d, t in docs.items()}
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip([None, *tokens[d]], tokens[d], strict=False))
    threes = Counter(p for d in train for p in zip([None, *tokens[d]], tokens[d], tokens[d][1:], strict=False))
    n, v = sum(c.values()), len(c)
    s2, s3 = lm.STRENGTH

    def p(w, b, a=()):
        one = (c[w] + 1) / (n + v + 1)
        two = (pairs[b, w] + s2 * one) / (c[b] + s2)
        return two if a == () else (threes[a, b, w] + s3 * two) / (pairs[a, b] + s3)

    for h in [(None,), ("the",), ("nosuchword",), ("de", None), ("la", "de"), ("nosuchword", "the"), ("of", "nosuchword")]:
        assert sum(p(w, *h) for w in c) + p("nosuchword", *h) == pytest.approx(1)
    for r in QUERIES["op10_language_model"](spark, SF).collect():
        own = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        score = math.log10(p(own[0], None)) + sum(math.log10(p(w, b, a)) for a, b, w in zip([None, *own], own, own[1:], strict=False))
        assert r.score == pytest.approx(score, rel=1e-6)


def test_pipeline_against_plain_stages(spark, con, docs):
    """Rows in and out of every stage, by plain Python where a stage is not the classifier's."""
    import corpus_pipeline as cp
    from vertexflow.storage import materialize

    now = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        now = materialize(stage(spark, now, SF), "test")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = now.select("doc_id").toPandas()["doc_id"].tolist()
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    good = set(kept["quality classifier"])
    assert all((d in good) == bool(q) for d, q in labels.items())
    last = {docs[d]: d for d in sorted(good)}
    assert sorted(kept["exact dedup"]) == sorted(last.values())

    sets = {}
    for d in kept["exact dedup"]:
        w = words(docs[d])
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter((a, b) for own in holders.values() for i, a in enumerate(own) for b in own[i + 1 :])
    for (a, b), m in both.items():
        if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(kept["near dedup"]) == sorted(d for d in sets if find(d) == d)
    times = Counter(kept["source mixing"])
    assert set(times) == set(kept["near dedup"]) and max(times.values()) <= 2
    packed = cp.STAGES[-1][1](spark, now, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packed.where("piece = 0").count() == len(kept["source mixing"])
