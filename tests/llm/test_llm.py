"""Each operator against brute force on small tables with nulls, empties, long texts and repeated rows."""

import bisect
import gzip
import hashlib
import heapq
import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formweave.llm import bpe, exact_dedup, forest, huffman, hub, jaccard, packing, quality, toxicity, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, score double, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1, 0.5, 7) for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    words = ["the", "of", "and", "zoë", "don't", "42", "naïve", "x,y", "end."]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(9000))
    return [(1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " tail"), (7, "a  b\nc d\te f"), (8, "日本語 テスト 😀 x"), (9, "  two  blanks \n\n here "), (9, "  two  blanks \n\n here "), (None, "no id"), (12, "a b c d e f"), (13, "a\x00b c\x01d")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    from tokenizers import Tokenizer

    tokens.tok = getattr(tokens, "tok", None) or Tokenizer.from_file(JSON)
    return [*tokens.tok.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("seed", range(20))
def test_supersteps_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 50, 2048])
    sizes = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(rng.choice([1, 5, 60]))}
    gaps, best = [], 0
    for length in sorted(sizes, reverse=True):
        for _ in range(sizes[length]):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else cap
            best += gap == cap
            bisect.insort(gaps, gap - length)
    by, used = defaultdict(list), defaultdict(list)
    for length, rank, seq, off in sorted(packing.supersteps(sizes, cap)):
        by[length].append((rank, seq, off))
    for length, n in sizes.items():
        for (rank, seq, off), after in zip(by[length], [*(r for r, _, _ in by[length][1:]), n], strict=True):
            for k in range(after - rank):
                used[seq + k].append((off, length))
    for items in used.values():
        assert [o for o, _ in sorted(items)] == [0, *itertools.accumulate(n for _, n in sorted(items))][:-1] and sum(n for _, n in items) <= cap
    assert len(used) <= best


def test_packing(spark, odd, empty):
    got = packing.pack_documents(odd, JSON).collect()
    want = Counter()
    for i, t in odd_rows():
        ids = tokens(t)
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        assert [o for o, _ in sorted(items)] == [0, *itertools.accumulate(n for _, n in sorted(items))][:-1] and sum(n for _, n in items) <= 2048
    assert packing.pack_documents(empty, JSON).count() == 0


def test_pieces_match_the_library():
    import pyarrow as pa

    texts = ["", "a  b", " a", "a ", "x\ny z", "x\n\ny", "don't we'll", "a\x1cb c", "<|endoftext|> a", "é ü ñ ½ ² №5", None, "q" * 5000, "tab\tz", " nbsp"]
    got = [np.frombuffer(x, "<u4").tolist() for x in hub.encoded(hub.read_vocabulary(JSON), pa.array(texts, pa.string()))]
    assert got == [tokens(t)[:-1] for t in texts]


def test_nearest_neighbours(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumn("score", F.lit(1)).withColumn("leaf", F.lit(2))
    extra = spark.createDataFrame([(10**6, None, 0), (10**6 + 50, [0.0] * 64, 0), (10**6 + 100, [float("nan")] * 64, 0), (10**6 + 150, [None] * 64, 0)], "vec_id long, embedding array<float>, label int")
    same = rows.limit(1).select("embedding", "label").crossJoin(spark.range(2000000, 2000020)).select(F.col("id").alias("vec_id"), "embedding", "label")
    table = rows.select("vec_id", "embedding", "label").unionByName(extra).unionByName(same)
    data = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows.select("vec_id", "embedding").unionByName(same.select("vec_id", "embedding")).collect()]
    ids, v = np.array([i for i, _ in data]), np.array([x for _, x in data])
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    found = defaultdict(list)
    for r in forest.nearest(table).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(ids[ids % 50 == 0].tolist())
    hit = total = 0
    for q, items in found.items():
        s = unit @ unit[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:5]
        items.sort()
        assert [r for r, _, _ in items] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in itertools.pairwise(items))
        for _, i, score in items:
            assert score == pytest.approx(float(s[ids == i][0]), abs=1e-12)
        hit += len(set(order) & {i for _, i, _ in items})
        total += 5
    assert hit / total >= 0.9
    assert forest.nearest(table.limit(0)).count() == 0


def test_bpe(spark, odd, empty):
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in odd_rows():
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.bpe_round_trip(odd, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert bpe.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert [table.probe(k) for k in keys] == list(range(3000)) and sorted(table.key_at) == list(range(3000))


def test_exact_dedup(spark, odd, empty):
    groups = defaultdict(list)
    for i, t in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for norm, items in groups.items():
        keep = min(items)
        want.update((i, keep[3], len(items), i == keep[3] and n == keep[0], hashlib.sha256(norm.encode()).hexdigest()) for n, _, _, i in items)
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd, runs=8).collect())) == want
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_components(rows, words, num, den):
    sets = []
    for i, t in rows:
        parts = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(parts[k:k + words]) for k in range(max(len(parts) - words, 0) + 1)) if parts else frozenset()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if (x and y and den * len(x & y) >= num * len(x | y)) or (sets[a][0] is not None and sets[a][0] == sets[b][0]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))


def near_copies(seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(160)]
    rows = [(1000, " ".join(base))]
    for k in range(80):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    return rows + [(200 + k, " ".join(f"u{rng.randint(0, 30)}" for _ in range(rng.randint(1, 60)))) for k in range(60)]


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(spark, words, num, den):
    rows = near_copies() + [r for r in odd_rows() if r[0] != 9]
    got = jaccard.similar_components(docs_of(spark, rows), words, num, den)
    assert Counter(map(tuple, got.collect())) == brute_components(rows, words, num, den)


def test_jaccard_of_nothing(empty):
    assert jaccard.similar_components(empty).count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ü x", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (7, "u\nv", ""), (9, "z", "<b>é</b>" * 5000), (9, "z", "<b>é</b>" * 5000), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, size int, digest string")
    got = warc.warc_round_trip(pages).collect()
    sha = lambda t: warc.base32_sha1((t or "").encode())
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, u, len((h or "").encode()), sha(h)) for i, u, h in rows)
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (7, "revisit", 2), (9, "response", None), (9, "revisit", 9)]
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[1] == "<p>x</p>"
    assert all(r.record_type == "response" for r in warc.warc_round_trip(pages, 10**6).collect())
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_rejects_damage():
    data = warc.record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    (member,) = warc.members(io.BytesIO(data))
    assert warc.parse(member)["payload"] == "payload" and gzip.decompress(data) == member
    for bad in (member.replace(b"payload", b"pAyload"), member[:-1], member.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-20])))


def test_code_lengths_are_optimal():
    rng = random.Random(1)
    counts = np.array([rng.randint(0, 50) for _ in range(60)])
    heap, cost = sorted(int(c) for c in counts if c), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    skewed = np.array([2**k for k in range(40)])
    lengths = huffman.code_lengths(skewed)
    assert lengths.max() == 16 and sum(2.0 ** -int(n) for n in lengths) == 1


def test_token_files(spark, odd, empty):
    got = huffman.token_round_trip(odd, JSON).collect()
    rows = sorted(((i is not None, i or 0, len(tokens(t)), crc(tokens(t)), i) for i, t in odd_rows()), key=lambda r: r[:3])
    start, want = 0, Counter()
    for _, _, n, c, i in rows:
        want[(i, start, n, c)] += 1
        start += n
    assert Counter(map(tuple, got)) == want
    assert huffman.token_round_trip(empty, JSON).count() == 0


def exhaustive(channel, word):
    """The cheapest reading over all paths of the lattice."""
    best = None
    for path in itertools.product(*(channel.options(word, i) for i in range(len(word)))):
        text = "".join(c for c, _ in path)
        total = channel.cost(text) + sum(x for _, x in path)
        if best is None or total < best[0] - 1e-12:
            best = (total, text)
    return best


def test_viterbi_finds_the_cheapest_reading():
    grams = Counter()
    for w, n in {"idiot": 5, "moron": 5, "stupid": 4, "the": 90, "other": 20, "is": 50, "pathetic": 3}.items():
        p = "^^" + w + "$"
        for i in range(len(p) - 2):
            grams[p[i:i + 3]] += n
    channel = toxicity.Channel(grams)
    for word in ["1d10t", "m0r0n", "iiidiot", "s.t.u.p.i.d", "5tup1d", "x1y", "th3", "i d i o t"]:
        assert channel.decode(word) == exhaustive(channel, word)[1]
    assert [channel.decode(w) for w in ("1d10t", "m0r0n", "i d i o t")] == ["idiot", "moron", "idiot"]


@pytest.mark.parametrize("module,target,folds", [(quality, "quality", 3), (toxicity, "toxic", 5)])
def test_classifiers_on_held_out_rows(spark, module, target, folds):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = module.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r[target] for r in got)
    assert right / len(got) >= 0.9
    for r in got:
        held = zlib.crc32(str(r.doc_id).encode()) % folds
        assert (held == 1 if folds == 3 else held == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_any_row(spark, odd, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = module.classify(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(odd_rows())
    assert got.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert module.classify(odd, labels.limit(0)).count() == len(odd_rows())
    assert module.classify(empty, labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns and set(map(tuple, rows)) <= set(map(tuple, docs.collect()))
        before = [(r.doc_id, r.text) for r in docs.collect()]
        kept = {r.doc_id for r in rows}
        if name == "exact dedup":
            groups = defaultdict(list)
            for i, t in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, _, c in brute_components(before, 5, 4, 5)}
        else:
            target = "toxic" if name == "toxicity" else "quality"
            known = [i for i, _ in before if i in labels]
            assert sum((i in kept) == (labels[i][target] == (target == "quality")) for i in known) / len(known) >= 0.9
        docs = spark.createDataFrame(rows, docs.schema)
