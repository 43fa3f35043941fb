"""The registered queries without SQL, on the whole of sf0.001, every row against plain Python; and empty tables."""

import collections
import hashlib
import itertools
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann, bpe, chat, decontamination, lm_scoring, near_dedup, secrets, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def probability_jaccard(a, b):
    """By its definition, over counters."""
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys())
    return total


def test_near_duplicates_on_all_documents(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = {}
    for i, t, *_ in read("documents"):
        w = words(t)
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else None
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations([i for i in bags if bags[i]], 2):
        common = len(bags[i].keys() & bags[j].keys())
        if common and (common / len(bags[i].keys() | bags[j].keys()) >= 0.8 or (max(max(bags[i].values()), max(bags[j].values())) > 1 and common > 3 and probability_jaccard(bags[i], bags[j]) >= 0.8)):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.query(spark, SF).collect()}
    assert got == {i: find(i) for i in bags}


def test_probability_jaccard_by_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = (collections.Counter(rng.integers(0, 12, 25).tolist()) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), "<u4").tobytes(), np.array([c[k] for k in sorted(c)], "<u4").tobytes())
        plain, weighted = near_dedup.likeness(*pack(a), *pack(b))
        assert abs(plain - len(a.keys() & b.keys()) / len(a.keys() | b.keys())) < 1e-12 and abs(weighted - probability_jaccard(a, b)) < 1e-12


def test_lm_base_on_all_documents(spark):
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for i, t, *_ in read("documents")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in lm_scoring.query(spark, SF).collect():
        ws = tokens.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws)) < 1e-6 * max(1, len(ws))
        assert math.isfinite(r.score) and r.score < 0
    assert not tokens


def test_vector_search_on_all_vectors(spark):
    rows = [(i, np.array(v, np.float64)) for i, v, *_ in read("embeddings")]
    got = collections.defaultdict(dict)
    for r in ann.query(spark, SF).collect():
        got[r.query_id][r["rank"]] = (r.score, r.vec_id)
    hits = total = 0
    for q, v in rows:
        if q % 100 == 0:
            want = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in rows if i != q)[:10]
            mine = [got[q][k] for k in range(1, len(want) + 1)]
            exact = dict((i, s) for s, i in sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in rows))
            assert mine == sorted(mine) and all(abs(exact[i] - s) < 1e-9 for s, i in mine)
            hits, total = hits + len({i for _, i in want} & {i for _, i in mine}), total + len(want)
    assert hits / total >= 0.9


def test_urls_on_all_pages(spark):
    import xxhash

    weights, bias = url_filter.fit(spark)
    urls = {i: u for i, u, *_ in read("pages")}
    for r in url_filter.query(spark, SF).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", urls.pop(r.page_id) or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(x), x, v) for x, v in url_filter.RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        text = f"^{host} {path}$"
        grams = [xxhash.xxh64(text[i : i + n].encode(), seed=42).intdigest() % url_filter.BUCKETS for n in url_filter.GRAMS for i in range(len(text) - n + 1)]
        z = bias + sum(weights[g] for g in grams) / math.sqrt(max(len(grams), 1))
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None)
        assert r.verdict == (max(fit)[2] if fit else "block" if z >= 0 else "allow")
    assert not urls


def plain_stretches(run, ratios):
    """Where the running sum of ratios less RATIO_EACH rises from nothing to a peak, widened to the nearest joint."""
    size = len(secrets.CHARACTERS)
    at = [secrets.CHARACTERS.index(c) for c in run]
    value = [ratios[a * size + b] for a, b in zip(at, at[1:])]
    if sum(value) >= max(secrets.RATIO, secrets.RATIO_EACH * len(run)):
        return [(0, len(run))]
    out, total, peak, low, high = [], 0.0, 0.0, 0, 0

    def close():
        n = high - low
        if n >= secrets.LEAST_STRETCH and peak + secrets.RATIO_EACH * (n - 1) >= secrets.RATIO:
            a, b = low, high
            joints = "/_=-"
            a = a + 1 if run[a] in joints else max((run.rfind(j, 0, a) for j in joints), default=-1) + 1
            ends = [k for j in joints if (k := run.find(j, b)) >= 0]
            b = b - 1 if run[b - 1] in joints else min(ends, default=len(run))
            if (a, b) not in out:
                out.append((a, b))

    for k, x in enumerate(value):
        if total <= 0:
            low = k
        new = total + x - secrets.RATIO_EACH
        if new <= 0 or peak - new > secrets.FALL:
            close()
            total, peak, high = 0.0, 0.0, 0
            continue
        if new > peak:
            peak, high = new, k + 2
        total = new
    close()
    return out


def test_secrets_on_all_documents(spark):
    ratios = secrets.ratios(secrets.random_strings(), secrets.ORDINARY)
    patterns = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    texts = {i: t or "" for i, t, *_ in read("documents")}
    found = 0
    for r in secrets.query(spark, SF).collect():
        t = texts.pop(r.doc_id)
        base = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(t) if (len(m[2]) >= 12 if k == 0 else len(m[0]) >= (18 if k == 1 else 16)))
        more = [(m.start() + a, 3, m.start() + b) for m in re.finditer(secrets.RUN, t) for a, b in plain_stretches(m[0], ratios)]
        join = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest() and r.spans == join(base + more), t
        found += len(more)
    assert not texts and found


def test_tokens_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    texts = {i: t or "" for i, t, *_ in read("documents")}
    for r in bpe.query(spark, SF).collect():
        ids = library.encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not texts


def test_chain_predictions_and_out_of_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    texts = {i: t or "" for i, t, *_ in read("documents")}
    for r in toxicity.query(spark, SF).collect():
        t = texts[r.doc_id]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        dense = [math.log1p(len(words)) / 10, 1 - sum(len(w.encode()) for w in words) / max(len(t.encode()), 1)]
        known = []
        for w in chain.models:
            own = {chain.index[x.encode()] for x in words if x.encode() in chain.index}
            n = len(chain.index)
            z = w[-1] + sum(w[k] for k in own) + sum(a * b for a, b in zip(w[n:], dense)) + sum(a * b for a, b in zip(w[n + 2 :], known))
            known.append(1 / (1 + math.exp(-max(-50, min(50, z)))))
        assert abs(r.p_quality - known[0]) < 1e-9 and abs(r.p_toxic - known[1]) < 1e-9 and r.is_toxic == (known[1] >= 0.5)
    # A document's own labels don't move the guesses that its fold's later model is trained with.
    rng = np.random.default_rng(0)
    rows = [(sorted(rng.choice(30, 5, replace=False).tolist()), (0.1, 0.2)) for _ in range(60)]
    y = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 2, 60)])
    seen = []

    class Watched(toxicity.Chain):
        def _model(self, rows_, cols, dense, y_, use, told, **how):
            seen.append((dense.copy(), use.copy()))
            return super()._model(rows_, cols, dense, y_, use, told, **how)

    def guesses(labels_):
        seen.clear()
        Watched(("a", "b"), [f"w{k}" for k in range(30)]).fit(rows, labels_)
        return seen[-1][0][:, -1]

    before, other = guesses(y), y.copy()
    fold = np.arange(60) % toxicity.FOLDS == 2
    other[fold, 0] = 1 - other[fold, 0]
    assert np.allclose(before[fold], guesses(other)[fold]) and not np.allclose(before[~fold], guesses(other)[~fold])
    # The optimiser ends near the least regularised loss: no gradient is left.
    chain2 = toxicity.Chain(("a",), [f"w{k}" for k in range(30)])
    chain2.fit(rows, y[:, :1])
    w = chain2.models[0]
    x = np.zeros((60, 33))
    for k, (c, d) in enumerate(rows):
        x[k, c], x[k, 30:32], x[k, 32] = 1, d, 1
    share = np.where(y[:, 0] > 0, math.sqrt((1 - y[:, 0]).sum() / y[:, 0].sum()), 1.0)
    g = x.T @ (share * (1 / (1 + np.exp(-(x @ w))) - y[:, 0])) + np.append(0.3 * w[:-1], 0)
    assert np.abs(g).max() < 0.5


@pytest.mark.parametrize("columns", ["doc_id long, text string"])
def test_empty_tables(spark, columns):
    none = spark.createDataFrame([], columns)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(ann.index(vectors), vectors).count() == 0
    assert bpe.digest(bpe.encoded(none, "c"), "c").count() == 0
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.formatted(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(none, toxicity.fit(none, labels), "p").count() == 0
    assert secrets.redacted(none).count() == 0 and near_dedup.deduplicated(none).count() == 0
    assert decontamination.matched(none, spark.createDataFrame([], "item_id long, text string"), "m").count() == 0


def test_long_texts_and_clashing_names(spark, make):
    import corpus_pipeline

    long = "word " * 400_000
    rows = make([(1, long, "x", 1.0), (2, "http://" + "a" * 200_000 + ".org/" + "b" * 200_000, "x", 2.0)], "doc_id long, text string, p string, score double")
    assert url_filter.judged(rows.withColumnRenamed("text", "path"), url="path").count() == 2
    chain = toxicity.fit(rows, spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.scored(rows, chain, "__p").columns == [*rows.columns, "__p"]
    scores = {r.doc_id: r for r in lm_scoring.scored(make([(1, long), (2, "x" * 20_000), (2, "x" * 20_000)], "doc_id long, text string"), chunk=1000).collect()}
    assert scores[1].n_tokens == 400_001 and math.isfinite(scores[2].score)
    out = chat.formatted(chat.linear(make([(1, 0, "user", long, 3), (1, 1, "assistant", long, 4)], "conv_id long, turn long, role string, text string, msg int"))).select(F.length("formatted").alias("n")).first()
    assert out.n > 4_000_000
    masked = corpus_pipeline.mask_secrets(spark, make([(1, "token = abcdefghijklmnop")], "doc_id long, text string"), SF)
    assert masked.columns == ["doc_id", "text"] and masked.first().text == "[SECRET]"


def test_one_id_with_two_texts(make):
    base = " ".join(f"w{k}" for k in range(50))
    rows = [(1, base), (5, base), (5, "something else entirely that nobody has copied at all"), (7, "something else entirely that nobody has copied at all !"), (None, base), (None, base)]
    kept = near_dedup.deduplicated(make(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept if r.doc_id is not None)) == [(1, base), (5, rows[2][1])] and sum(r.doc_id is None for r in kept) == 2
