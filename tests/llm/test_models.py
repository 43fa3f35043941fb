"""Near duplicates, classifier, LM scores, vector search, URL and chat operators against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import ann, chat, lm_scoring, near_dedup, toxicity, url_filter


def shingle_set(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates(make):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 6, 60, 200, 400, 2000)]
    rows = list(enumerate(base))
    for b in base[2:]:
        for _ in range(15):
            w = b.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, base[3].upper() + "!") for k in range(30)] + [(900, None), (901, ""), (902, "..."), (903, ""), (None, base[3])]
    docs = make([(i, t, "a") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert len(got) == len(rows) - 1 and all(got[i] == i for i in (900, 901, 902, 903))
    sets = {i: shingle_set(t) for i, t in rows if i is not None and shingle_set(t)}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a, b in itertools.combinations(sorted(sets), 2):
        s = near(a, b)
        assert got[a] == got[b] or s < 0.8, (a, b, s)
        assert got[a] != got[b] or s > 0.2, (a, b, s)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(got.values())) and kept.where("doc_id IS NULL").count() == 1
    again = near_dedup.deduplicated(docs.unionByName(docs.where("doc_id IN (0, 900)")))
    assert again.where("doc_id = 0").count() == 1
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_near_duplicates_in_a_family_without_its_original(make):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = rng.choices(vocabulary, k=200)
    texts = []
    for _ in range(2200):
        w = list(base)
        for k in rng.sample(range(200), 4):
            w[k] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    column = {}
    for s in sets:
        for x in s:
            column[x] = column.get(x, 0) + 1
    column = {x: k for k, x in enumerate(x for x, n in column.items() if n > 1)}
    m = np.zeros((len(sets), len(column)), np.float32)
    for k, s in enumerate(sets):
        m[k, [column[x] for x in s if x in column]] = 1
    common, size = (m @ m.T).astype(float), np.array([len(s) for s in sets])
    near = np.argwhere(np.triu(common / (size[:, None] + size[None, :] - common) >= 0.8, 1))
    want = list(range(len(sets)))
    for _ in range(len(near)):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
        if all(want[a] == want[b] for a, b in near):
            break
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    lost = sum(got[a] != got[b] for a, b in near)
    assert len(near) > 50 and lost == 0, f"{lost} of {len(near)} links lost"
    assert [got[k] for k in range(len(sets))] == want


def test_near_duplicates_with_repeated_lines(make):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for _ in range(12):
        text, line = " ".join(rng.choices(vocabulary, k=300)), " ".join(rng.choices(vocabulary, k=6))
        rows += [text, *(text + f" {line}" * n for n in (50, 100))]
        # Plain Jaccard is low here, and probability Jaccard high.
        rows += [" ".join(rng.choices(vocabulary, k=20)) + f" {line} x" * 150 for _ in range(2)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make(list(enumerate(rows)), "doc_id long, text string").repartition(2)).collect()}
    assert [got[k] for k in range(len(rows))] == [k - k % 5 + (0 if k % 5 < 3 else 3) for k in range(len(rows))]


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        items = rng.integers(0, 2**63, 80).astype(np.uint64)
        x, y = rng.integers(1, 6, 80).astype(float), rng.integers(1, 6, 80).astype(float)
        a, b = np.sort(rng.permutation(80)[:60]), np.sort(rng.permutation(80)[:60])
        sig = near_dedup.signatures([(items[a], x[a]), (items[b], y[b])], 160)
        u, v = dict(zip(a, x[a])), dict(zip(b, y[b]))
        exact = sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in u.keys() | v.keys()) for d in u.keys() & v.keys())
        errors.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_toxicity(spark, make):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = toxicity.scored(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), chain, "p").select("toxic", (F.col("p")[1] >= 0.5).cast("int").alias("guess")).collect()
    assert sum(r.toxic == r.guess for r in held) / len(held) > 0.9
    odd = make([(1, None, 0.5), (2, "", None), (2, "", None)], "doc_id long, text string, p0 double")
    assert [len(r.p) for r in toxicity.scored(odd, chain, "p").collect()] == [2, 2, 2]
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(odd, empty, "p").where("p[1] >= 0.5").count() == 0


def test_lm_scores(make):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "The", "naïve", "日本", "unbelievable", "zqxj", "\u00a0x"], k=n)) for n in (0, 1, 5, 40)] + [None, "  \t\n", "a" * 300]
    rows = [(k, texts[k % len(texts)]) for k in range(60)]
    out = {r.doc_id: r for r in lm_scoring.scored(make([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3), chunk=50).collect()}
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = {}
    for i, t in rows:
        for w in tokens(t) if not held(i) else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        r, w = out[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(x in counts for x in w), n)
        assert abs(r.base_score - sum(math.log10((counts.get(x, 0) + 1) / (n + 1 * (v + 1))) for x in w)) < 1e-9 and r.score < 0 and math.isfinite(r.score)
    # The score, by listing all segmentations of each word: the pieces' shares, one round of expected counts, whole words.
    import public_tokenizers

    first = lm_scoring.Lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    prior, plain = np.exp(first.logp), {p: k for k, p in enumerate(first.pieces) if k != first.end and not p.startswith("<0x")}

    def segmentations(s):
        if not s:
            yield []
            return
        for tail in segmentations(s[1:]):
            yield [*(first.bytes + b for b in s[0].encode()), *tail]
        for k in range(1, len(s) + 1):
            if s[:k] in plain:
                for tail in segmentations(s[k:]):
                    yield [plain[s[:k]], *tail]

    listed = {w: list(segmentations("\u2581" + w)) for w in counts if w and len(w) < 9}
    few = [(i, t) for i, t in rows if len(t or "") < 250 and all(len(x or "") < 9 for x in tokens(t))]
    few_counts = {}
    for i, t in few:
        for w in tokens(t) if not held(i) else ():
            few_counts[w] = few_counts.get(w, 0) + 1
    expected = np.zeros(len(prior))
    expected[first.end] = few_counts[None]
    for w, c in few_counts.items():
        if w:
            weights = [math.prod(prior[k] for k in x) for x in listed[w]]
            for x, p in zip(listed[w], weights):
                for k in x:
                    expected[k] += c * p / sum(weights)
    again = (expected + lm_scoring.PRIOR * prior) / (expected.sum() + lm_scoring.PRIOR * prior.sum())
    n, v = sum(few_counts.values()), len(few_counts)
    p = lambda w: again[first.end] if w is None else sum(math.prod(again[k] for k in x) for x in listed[w])
    for r in lm_scoring.scored(make(few, "doc_id long, text string")).collect():
        assert abs(r.score - sum(math.log10((few_counts.get(w, 0) + v * p(w)) / (n + v)) for w in tokens(texts[r.doc_id % len(texts)]))) < 1e-6
    assert lm_scoring.scored(make([], "doc_id long, text string")).count() == 0


def test_lattice_sums_all_segmentations():
    import public_tokenizers

    lattice = lm_scoring.Lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    logp = dict(zip(lattice.pieces, lattice.logp))

    def total(s):
        spelled = lambda c: math.exp(sum(lattice.logp[lattice.bytes + b] for b in c.encode()))
        if not s:
            return 1.0
        return spelled(s[0]) * total(s[1:]) + sum(math.exp(logp[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in logp and not s[:k].startswith("<"))

    words = ["the", "naïve", "語x", "unable"]
    got = lattice.log_probabilities([w.encode() for w in words])
    assert np.allclose(got, [math.log(total("▁" + w)) for w in words])
    counts = lattice.expected([w.encode() for w in words], np.ones(4))
    assert abs(sum(len(p) * c for p, c in zip(lattice.pieces, counts) if not p.startswith("<0x")) + sum(counts[lattice.bytes : lattice.bytes + 256]) - sum(len(w) + 1 for w in words)) < 3


def test_vector_search(make):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    rows = [(int(k), [float(a) for a in v]) for k, v in enumerate(x)] + [(2000 + k, [1.0] * 16) for k in range(300)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None]), (None, [1.0] * 16), (5400, [1.0, 2.0])]
    df = make([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, label string")
    found = ann.search(ann.index(df, shard=400), df.where("vec_id % 100 = 0"), block=7)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for q, v in sound:
        if q % 100:
            continue
        want = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, u in sound if i != q)[:10]
        mine = [got[q][k] for k in range(1, 11)]
        assert mine == sorted(mine)
        hits += len({i for _, i in want} & {i for _, i in mine})
        total += 10
    assert hits / total >= 0.95 and 5400 not in got
    assert [i for _, i in (got[2000][k] for k in range(1, 11))] == list(range(2001, 2011))


def test_urls(make):
    urls = [None, "", "nothing", "http://WWW.Example.com/en/a?x#y", "https://example.com/en/", "http://a.example.com/en", "http://example.com", "x://b.net/es/1://c.com/", "http://évil.NET/fr/", "http://casino-win.bets.org/play", "http://docs.library.org/guide", "ftp://notexample.com/en/1", "http://net/es/?"]
    rows = url_filter.judged(make([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")).orderBy("page_id").collect()
    for r, u in zip(rows, urls, strict=True):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(x), x, v) for x, v in url_filter.RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None)
        assert r.verdict == (max(fit)[2] if fit else "block" if r.score >= 0.5 else "allow")
    assert [r.verdict for r in rows[9:11]] == ["block", "allow"]


def test_url_grams(spark):
    import xxhash

    for h, p in (("ab.c", "/x"), ("", ""), ("é", "")):
        text = f"^{h} {p}$"
        want = [xxhash.xxh64(text[i : i + n].encode(), seed=42).intdigest() % 1024 for n in (3, 4, 5) for i in range(len(text) - n + 1)]
        assert spark.range(1).select(url_filter.grams(F.lit(h), F.lit(p), buckets=1024).alias("g")).first().g == want


def test_url_rules_by_join(make):
    urls = [f"http://{'a.' * (k % 3)}h{k % 50}.org/{'x' * (k % 7)}/{k}" for k in range(300)] + ["http://.org/", None, "http://h3.org./x", "nothing", "http://a..h1.org/x/"]
    rules = [(f"h{k}.org/{'x' * (k % 5)}", "allow" if k % 2 else "block") for k in range(60)] + [(f"s{k}.net/p{k}/", "block") for k in range(100_000)] + [("org/", "block"), ("h1.org/x/", "allow"), ("h1.org/x/", "block")]
    pages = make([(k, u) for k, u in enumerate(urls)], "page_id long, path string")
    joined = {r.page_id: r for r in url_filter.judged(pages, url="path", rules=rules).collect()}
    few = [r for r in rules if not r[0].startswith("s")]
    assert len(joined) == len(urls) and len(few) < url_filter.INLINE_RULES
    for r in url_filter.judged(pages, url="path", rules=few).collect():
        assert tuple(r) == tuple(joined[r.page_id])


def test_url_model_on_hosts_it_was_not_fitted_on(spark, make):
    # Hosts that the labelled table doesn't have, neither whole nor their pairs of words.
    block = ["spam-farm", "casino-win", "cheap-pills", "adult-x", "free-bets", "poker-palace", "viagra-shop", "xxx-videos", "payday-cash", "lottery-scam", "torrents-cracked", "replica-bags"]
    allow = ["theron", "ththor", "tionsh", "encyclopedia", "grandmother", "carpentry", "philosophy", "elections", "geology", "courthouse", "violin", "daffodils", "parliament", "breadmaking", "observatory", "linguistics"]
    known = " ".join(u for u, _ in url_filter.LABELLED)
    assert not any(h in known for h in block + allow)
    rows = [(k, f"https://{sub}{h}.example.org/{p}", h in block) for k, h in enumerate(block + allow) for sub in ("", "www.", "m.") for p in ("", "en/14", "de/200.html")]
    got = url_filter.judged(make(rows, "page_id long, url string, bad boolean"), rules=()).collect()
    caught = [r.verdict == "block" for r in got if r.bad]
    wrong = [r.verdict == "block" for r in got if not r.bad]
    assert sum(caught) / len(caught) > 0.8 and sum(wrong) / len(wrong) < 0.05, (sum(caught) / len(caught), sum(wrong) / len(wrong))


def test_chat(spark, make):
    rows = [(1, 0, "user", "a\\l <s> [INST]"), (1, 1, "assistant", "</s>\\s"), (1, 2, None, None), (None, 0, "user", "x"), (3, 5, "assistant", "é😀"), (3, 5, "assistant", "é😀"), (4, None, "tool", "<<s>>")]
    out = {r.conv: r for r in chat.formatted(chat.linear(make(rows, "conv_id long, turn long, role string, text string"))).select("conv", "formatted", "loss", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("user", "a\\l <s> [INST]"), ("assistant", "</s>\\s"), ("", "")]
    assert [(t.role, t.text) for t in out[3].back] == [("assistant", "é😀")] * 2 and len(out[3].loss) == 2 and None in out
    tree = [("c", 1, None, "user", "q", 0.0), ("c", 2, 1, "assistant", "bad", 0.1), ("c", 3, 1, "assistant", "good", 0.9), ("c", 4, 3, "user", "more", 0.5), ("c", 5, 4, "assistant", "end", 0.5), ("c", 6, 4, "assistant", "best", 0.8), ("c", 8, 9, "user", "z", 0.0), ("c", 9, 8, "user", "z", 0.0), ("c", 10, 77, "user", "lost parent", 0.0)]
    got = chat.paths(make(tree, "conv string, msg long, parent long, role string, text string, score double")).orderBy("root", "place").collect()
    assert [(r.root, r.leaf, r.msg, r.place) for r in got] == [(1, 6, 1, 1), (1, 6, 3, 2), (1, 6, 4, 3), (1, 6, 6, 4), (10, 10, 10, 1)]
    two = chat.paths(make(tree, "conv string, msg long, parent long, role string, text string, score double"), keep=2)
    assert {r.leaf for r in two.where("root = 1").collect()} == {5, 6}


def test_pipeline(spark, make, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    names = docs.columns
    extra = [(10_001, rows[3][1], "en", "copy", 1), (10_002, None, None, None, None), (10_003, 'api_key = "Zx81kd02mfP9qq7Lw3"', "en", "s", 1), (10_004, "idiot moron trash scum loser worthless pathetic clown", "en", "t", 1)]
    spark.createDataFrame(rows + extra, docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert 10_001 not in ids and 10_002 in ids and 10_003 in ids and ids <= {r[0] for r in rows + extra}
    masked = corpus_pipeline.mask_secrets(spark, spark.createDataFrame(extra[2:3], docs.schema), source).first()
    assert masked.text == '[SECRET]"' and masked.n_chars == 9
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), "/root/testdata/sf0.001").columns == names, name
    assert hashlib.sha256(b"").hexdigest() in {r.ids_sha256 for r in out.where("doc_id = 10002").collect()}
