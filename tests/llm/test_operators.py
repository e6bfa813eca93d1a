"""Each operator against brute force on a small fixture with nulls, empty, very long and repeated rows."""

import base64
import collections
import hashlib
import itertools
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from admitflow.llm import exact_dedup, jaccard_join, language_id, license_scan, mixing, packing, quality, topk_search, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    out = []
    for i in range(60):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([1, 3, 8, 40, 120]))]
        out.append((i, " ".join(words), "en", f"s{i % 4}", None))
        if i % 5 == 0:
            out.append((100 + i, " ".join(words), "en", None, 3))
        if i % 7 == 0 and len(words) > 30:
            out.append((200 + i, " ".join(words[:-1] + ["other"]), "fr", "s1", 3))
    return [*out, (300, None, None, None, None), (301, "", "en", "s0", 0), (301, "", "en", "s0", 0), (302, "long " * 30_000, "de", "s2", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)


def test_url_trie_and_join_agree(spark):
    urls = ["http://a.net/x", "http://A.example.NET/en/x", "http://x.example.com/de/", "https://b.org/fr/1?q", "http://b.org/frx", "http://net", None, "no", "http://example.com/de", "x://q.net/#f"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    one = sorted(tuple(r) for r in url_filter.filter_urls(pages).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    two = sorted(tuple(r) for r in url_filter.filter_urls(pages, max_trie_rules=0).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    assert one == two
    assert [r[3] for r in one] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", "-", "-", "-", "-", "-", "net/"]


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, target, most = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1
    assert mixing.mix(docs.limit(0)).count() == 0
    repeated = mixing.mix_rows(docs)
    assert repeated.columns == docs.columns
    words = repeated.agg(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert abs(words - sum(target.values())) <= sum(most.values())


def test_exact_dedup(docs, rows):
    got = exact_dedup.deduplicate(docs).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    assert all(r["keep_id"] == max(by_hash[r["text_sha256"]]) and r["group_size"] == len(by_hash[r["text_sha256"]]) for r in got)
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_digest_index_persists_and_batches_may_be_run_again(spark, docs, rows, tmp_path):
    texts = {r[1] or "" for r in rows}
    path = f"file://{tmp_path}/it's an index"
    first = exact_dedup.keep_first(docs.filter("doc_id < 150"), exact_dedup.DigestIndex(spark, path, buckets=4), batch="a").count()
    again = exact_dedup.keep_first(docs.filter("doc_id < 150"), exact_dedup.DigestIndex(spark, path), batch="a").count()
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 4 and first == again == len({r[1] or "" for r in rows if r[0] < 150})
    assert exact_dedup.keep_first(docs, index, batch="b").count() == len(texts) - first
    assert exact_dedup.keep_first(docs, index, batch="c").count() == 0
    assert index.read().count() == len(texts)
    index.drop()


def test_digest_index_meets_new_rows_in_a_sort_merge_anti_join(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    pairs = exact_dedup.digests(docs)
    index.add(pairs, "a")
    groups = pairs.groupBy("digest").agg(F.max("key").alias("keep_id"), F.sum("copies").alias("rows"))
    plan = index.unseen(groups, "b")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in side and side.count("Exchange hashpartitioning(digest") == side.count("4), REPARTITION_BY_NUM") + 1  # the groups' own
    index.drop()


def test_whole_rows_keep_columns_with_clashing_names(spark):
    names = ["_key", "_keep", "_row", "_digest", "_hash", "_nth", "_one", "_all", "_text", "_source", "key", "rows", "score", "digest", "START"]
    rows = [(i, f"a text of words that are here {i // 2} times", "s", float(i)) for i in range(6)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars double").select("*", *[F.lit("x").alias(n) for n in names])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = {
        "exact": exact_dedup.keep_first(frame), "near": jaccard_join.keep_one(frame), "mixed": mixing.mix_rows(frame), "good": quality.keep_good(frame, labels, threshold=0.0),
    }
    assert all(f.columns == frame.columns for f in kept.values())
    assert sorted(r["doc_id"] or -1 for r in kept["exact"].collect()) == [-1, 1, 3, 5]
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept["near"].collect()) == [-1, 0, 2, 4]
    assert kept["good"].count() == 7 and all(r["_key"] == "x" for r in kept["mixed"].collect())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 40)])
def test_jaccard_join(spark, docs, rows, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    draw = random.Random(5)
    for i in range(400, 412):  # sizes far apart, each inside the next
        more = (i, " ".join(f"z{k}" for k in range(4, 8 + 2 * (i - 400)) if draw.random() < 0.97), "en", "s", 1)
        rows = [*rows, more]
        docs = docs.unionByName(spark.createDataFrame([more], SCHEMA), allowMissingColumns=True)
    sets, root = {}, {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_join(docs.coalesce(3), n, percent).collect()
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])) for r in got)


def test_packing(docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    from admitflow.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in rows)
    got = packing.pack(docs, tokenizer_path()).collect()
    room = collections.defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in room.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and (at & (at - 1)) == 0
    assert sum(r["length"] for r in got) == sum(len(b) * n for b, n in want.items()) // 4
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r[0]].append(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc, own in pieces.items():
        assert len({r["doc_tokens"] for r in own}) == 1 and len(set(ids[doc])) == 1
        whole, copies, ends = ids[doc][0], len(ids[doc]), collections.Counter()
        for r in own:
            assert zlib.crc32(whole[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
            ends[r["start"]] += 1
            ends[r["start"] + r["length"]] -= 1
        # every copy's pieces begin where others end, from its first id to its last
        assert {at: n for at, n in ends.items() if n} == {0: copies, len(whole) // 4: -copies}


def test_odd_texts_tokenize_alike():
    import numpy as np

    from admitflow.llm.queries import tokenizer_path

    w = packing.WordIds(tokenizer_path())
    texts = ["It's we'll DON'T <|endoftext|>", "À ½²x9 İ", "ΣΑΣ", "a\u0301 é", "\x1c a\x85b\xa0c", "'s!!'s ''t", "", " \n", "12ab_--!!'re", "สวัสดี"]
    assert w.encode(texts) == [np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_warc_round_trip(spark):
    pages = [(5, "http://a\r\nb", "x"), (3, None, "x"), (9, "u", None), (7, "u", ""), (8, "v", "y" * 200_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder, index = warc.write_archive(frame)
    got = {r["key"]: r for r in warc.read_records(folder, index, range_bytes=100).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 7), 7: ("response", None), 8: ("response", None)}
    assert all(got[k]["payload_digest"] == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() and got[k]["payload_bytes"] == len(h or "") for k, _, h in pages)
    assert warc.read_records(*warc.write_archive(frame.limit(0))).count() == 0


def test_warc_keys_of_text(spark):
    pages = [("b <1>", "u", "x"), ("null", "u", "x"), (None, "u", "x"), ("ü\n", "u", "z")]
    frame = spark.createDataFrame(pages, "page_id string, url string, html string")
    folder, index = warc.write_archive(frame)
    got = {(r["key"], r["record_type"], r["refers_to"]) for r in warc.read_records(folder, index, key_type="string").collect()}
    assert got == {("b <1>", "response", None), ("null", "revisit", "b <1>"), (None, "revisit", "b <1>"), ("ü\n", "response", None)}


def test_top_k(spark):
    draw = random.Random(4)
    vectors = [(i % 90, [draw.choice([0.0, draw.gauss(0, 0.3)]) for _ in range(6)]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(frame, F.col("vec_id") % 20 == 0, k=7, query_block=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    import math

    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in whole if i % 20 == 0}:
        own = min(v for i, v in whole if i == q)
        want = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q))[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_top_k_of_huge_components(spark):
    vectors = [(0, [1e300, 2.0]), (1, [1e-302, 5.0]), (2, [-1e300, 0.0]), (3, [0.0, 1e13]), (20, [0.0, 3.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)
    got = topk_search.top_k(frame, F.col("vec_id") == 20, k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 64 * 10**13 * 192), (1, 320 * 192)]


def test_scattering_terms_is_the_inner_product():
    import numpy as np

    rng = np.random.default_rng(3)
    for top, rare in itertools.product((5, 1 << 15, 1 << 28, 1 << 40), (2, 12)):  # long lists of postings, then short ones
        q, c = (rng.integers(-top, top, (n, 7)) * (rng.integers(0, rare, (n, 7)) == 1) for n in (19, 31))
        assert (topk_search.accumulate(q, c) == q.astype(object) @ c.astype(object).T).all()


def test_classifiers(spark, docs):
    good = [(i, f"the quick brown fox {i} jumps over lazy dogs and cats. " * 6, "en" if i % 2 else "de", "s", 3) for i in range(80)]
    good = [(i, t if la == "en" else t.replace("the", "der").replace("and", "und ßüö"), la, s, n) for i, t, la, s, n in good]
    bad = [(100 + i, f"BUY!!! NOW### %%% {i} " * 12, "en", "s", None) for i in range(40)]
    frame = spark.createDataFrame(good + bad + [(500, None, None, None, None), (501, "", "en", None, 1), (502, "12 34", "en", None, 1)], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(frame, labels).collect()}
    assert len(got) == 123 and all(got[r[0]]["predicted"] == 1 for r in good) and all(got[r[0]]["predicted"] == 0 for r in bad)
    found = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    assert found[500]["lang_pred"] == found[501]["lang_pred"] == found[502]["lang_pred"] == "und"
    assert sum(found[r[0]]["lang_pred"] == r[2] for r in good) >= 76
    assert quality.classify(frame.limit(0), labels).count() == 0 and language_id.identify(frame.limit(0)).count() == 0


def test_license_scan(spark):
    texts = [(1, "x y z Released under the MIT License. more"), (2, None), (3, ""), (4, "released UNDER the mit license"), (5, "under the MIT License."), (1, "a " * 3000 + "Licensed under CC BY-NC 4.0. " + "b " * 3000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for listed in (license_scan.MAX_LISTED, 0):
        got = {(r["doc_id"], r["license"], r["first_word"]) for r in license_scan.scan(frame, max_listed=listed).collect()}
        assert got == {(1, "MIT", 3), (4, "MIT", 0), (1, "CC-BY-NC-4.0", 3000)}
    assert license_scan.scan(frame.limit(0)).count() == 0 and license_scan.scan(frame, []).count() == 0
    odd = license_scan.scan(frame, [("O'Neill's \"own\"", "Released under the MIT License")]).select("license").distinct().collect()
    assert [r["license"] for r in odd] == ["O'Neill's \"own\""]


def test_license_bands_find_changed_templates(spark):
    """Every template with every fifth part of its shingles broken in another way, against containment without retrieval."""
    draw, texts = random.Random(8), []
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        for trial in range(6):
            changed = list(words)
            for _ in range(max(0, len(words) // 25) if trial else 0):
                at = draw.randrange(len(changed))
                changed[at : at + 1] = draw.choice([[], ["other"], [changed[at], "more"]])
            front = [f"f{draw.randrange(99)}" for _ in range(trial)]
            texts.append((len(texts), " ".join([*front, *changed, "end"])))
    frame = spark.createDataFrame(texts, "doc_id long, text string")

    def shingles(text):
        import regex

        w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = set()
    for i, text in texts:
        of = shingles(text)
        for t, (_, template) in enumerate(license_scan.TEMPLATES):
            own = set(shingles(template))
            long = len(own) + len(own) // 4
            if max((len(own & set(of[k : k + long])) for k in range(len(of)) if of[k] in own), default=0) >= 0.8 * len(own):
                want.add((i, t))
    got = {(r["doc_id"], r["template"]) for r in license_scan.scan(frame).collect()}
    assert got == want and len(want) > len(license_scan.TEMPLATES) * 3


def _cheapest_first(lengths, capacity, quadratic):
    """The packing rule, by looking at every sequence for every piece."""
    out, pieces, total, full = [], [], 0, 0
    for d, n in enumerate(lengths):
        for at in range(0, n - n % capacity, capacity):
            out.append((d, at, capacity, full, 0))
            full += 1
        if n % capacity:
            pieces.append((n % capacity, d, n - n % capacity))
            total += n % capacity
    rooms = [capacity] * (total // capacity)
    rooms += [1 << b for b in range(20, -1, -1) if total % capacity >> b & 1]
    left, cost = list(rooms), [0.0] * len(rooms)
    for n, d, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while n:
            fit = [s for s in range(len(rooms)) if left[s] >= n]
            s = min(fit, key=lambda s: (cost[s], s)) if fit else min((s for s in range(len(rooms)) if left[s]), key=lambda s: (-left[s], cost[s], s))
            k = min(n, left[s])
            out.append((d, start, k, full + s, rooms[s] - left[s]))
            left[s] -= k
            cost[s] += k + quadratic * k * k
            n, start = n - k, start + k
    return out


def test_packing_takes_the_cheapest_sequence_with_room():
    draw = random.Random(1)
    for _ in range(200):
        capacity = draw.choice([8, 16, 64])
        lengths = [draw.choice([draw.randrange(1, capacity), draw.randrange(1, 3 * capacity), 1]) for _ in range(draw.randrange(80))]
        assert packing.pack_group(lengths, capacity, 1.0, 1 / capacity) == _cheapest_first(lengths, capacity, 1 / capacity)


def test_pivoting_with_the_rest_of_a_bucket():
    """The walk's straight line against fractions that are all changed one by one, and means that are kept."""
    draw = random.Random(3)
    for _ in range(200):
        sizes = sorted((draw.choice([1, 3, 50, 400]) for _ in range(draw.randrange(1, 12))), reverse=True)
        now = [draw.choice([0.3, draw.random()]) for _ in sizes]
        luck = [draw.random() for _ in sizes]
        walk = mixing._Walk(sum(sizes), sum(b * q for b, q in zip(sizes, now)), 0, len(sizes))
        got = [walk.next(b, q, u) for b, q, u in zip(sizes, now, luck)]
        words = sum(b * q for b, q in zip(sizes, now))
        for i, b in enumerate(sizes):
            rest = range(i + 1, len(sizes))
            mass, total = sum(sizes[j] * now[j] for j in rest), sum(sizes[j] for j in rest)
            up, down = min((1 - now[i]) * b, mass), min(now[i] * b, total - mass)
            if up + down <= 1e-9 or now[i] in (0.0, 1.0):
                continue
            if luck[i] * (up + down) < down:
                now[i] += up / b
                for j in rest:
                    now[j] *= (mass - up) / mass if mass else 0
            else:
                now[i] -= down / b
                for j in rest:
                    now[j] = 1 - (1 - now[j]) * ((total - mass - down) / (total - mass) if total > mass else 0)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, now)) and abs(sum(b * q for b, q in zip(sizes, got)) - words) < 1e-6
        assert sum(1e-9 < q < 1 - 1e-9 for q in got) <= 1
    means = [0.0] * 3
    for _ in range(4000):
        walk = mixing._Walk(9, 9 * 0.4, 0, 3)
        for i, b in enumerate((5, 3, 1)):
            means[i] += walk.next(b, 0.4, draw.random()) / 4000
    assert all(abs(m - 0.4) < 0.04 for m in means)


@pytest.mark.parametrize(("table", "most"), [("sf0.001", 0.05), ("sf0.01", 0.01)])
def test_sources_come_near_their_targets(spark, table, most):
    path = f"/root/testdata/{table}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    mixed = mixing.mix(spark.read.parquet(path))
    found = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count_if(F.col("part") > 0).alias("parts")).collect()
    assert all(abs(r["taken"] - r["target"]) <= most * r["target"] and r["parts"] <= 1 for r in found)
    assert mixed.filter("taken > 2 * size").count() == 0


def test_sources_planned_apart_have_the_same_targets(spark):
    draw = random.Random(9)
    sizes = [(f"s{i}", draw.choice([0, 5, 80, 3000]), 1) for i in range(40)] + [(None, 70, 1), ("é", 9, 1)]
    frame = spark.createDataFrame(sizes, "source string, size long, rows long")
    want = {s: t for s, _, t in mixing.plan_targets([(s, n) for s, n, _ in sizes], (3, 1, 2), 1.5, 2.0)}
    got = {r["source"]: r["target"] for r in mixing._planned(frame, (3, 1, 2), 1.5, 2.0, 5)[0].collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_factorisation_machine_is_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    width, dense = quality.BUCKETS + 3, 3
    m = quality.Machine(0.2, rng.normal(size=width), rng.normal(size=(width, 4)), np.zeros(dense), np.ones(dense))
    sizes, bucket = np.array([3, 0, 5]), rng.choice(quality.BUCKETS, 8, replace=False)
    value, x = rng.normal(size=8), rng.normal(size=(3, dense))
    got, _ = m.parts(bucket, value, sizes, x)
    at = 0
    for row, n in enumerate(sizes):
        whole = np.zeros(width)
        whole[bucket[at : at + n]] = value[at : at + n]
        whole[quality.BUCKETS :] = x[row]
        at += n
        live = np.flatnonzero(whole)
        want = m.bias + whole @ m.weights + sum(m.factors[i] @ m.factors[j] * whole[i] * whole[j] for i in live for j in live if i < j)
        assert abs(got[row] - want) < 1e-8


def test_network_is_convolution_pooling_and_softmax_by_loops():
    import numpy as np

    net = language_id.fit(np.zeros((0, language_id.WINDOW), np.uint8), np.zeros(0, int), ["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    widest, d = max(language_id.WIDTHS), net.embed.shape[1]
    for row, got in zip(x, net.chances(x)):
        pooled = []
        for f in range(net.filters.shape[1]):
            best = max(sum(net.embed[row[at + k], c] * net.filters[k * d + c, f] for k in range(widest) for c in range(d)) for at in range(language_id.WINDOW - widest + 1))
            pooled.append(max(0.0, best + net.bias[f]))
        z = np.exp(np.array(pooled) @ net.out + net.out_bias)
        assert np.allclose(got, z / z.sum(), atol=1e-4)
    widths = [int(np.flatnonzero(net.filters[:, f].reshape(widest, d).any(axis=1)).max()) + 1 for f in range(net.filters.shape[1])]
    assert sorted(set(widths)) == sorted(language_id.WIDTHS)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(6)
    clean = [(i, " ".join(draw.choice(["river", "stone", "walks", "under", "light", "green", "with", "many", "small", "birds", "along", "north"]) for _ in range(60)) + ".", "en", f"s{i % 3}", 300) for i in range(60)]
    bad = [(100 + i, f"BUY!!! NOW### %%% {i} " * 12, "en", "s1", 200) for i in range(30)]
    copies = [(200, clean[0][1], "en", "s0", 300), (201, clean[1][1].replace("river", "river", 1) + " end", "en", "s1", 300), (202, None, None, None, None), (203, "", "en", "s2", 0)]
    frame = spark.createDataFrame([*clean, *bad, *copies], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in clean] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, docs = {}, frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        assert docs.columns == frame.columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
    ids = {r[0] for r in clean}
    assert ids <= kept["quality"] and not kept["quality"] & {r[0] for r in bad}
    assert kept["exact_dedup"] == kept["quality"] - {0} and kept["jaccard_join"] == kept["exact_dedup"] - {201}
    assert kept["mixing"] <= kept["jaccard_join"] and corpus_pipeline.run(spark, str(tmp_path)).filter("length > 0").count() > 0
