"""The ten operators against brute force, exact round trips and held-out labels, with odd rows among the input."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("vellum.llm")

from vellum.llm import bagminhash, bpe, chat, linededup, lz, media, reshard, tokencount, toxicity, wfq  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, row string, base string, key string, part int"


def make_docs():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 90))) for _ in range(40)]
    near = [" ".join(w if i != 7 else "changed" for i, w in enumerate(t.split())) for t in texts[:8]]
    line = "This line is in many documents, word for word."
    texts += near + texts[:5] + [f"{texts[k]}\n {line.upper()} \nown {k}" for k in range(10, 16)] + [f"{line}\n{line}\nend"]
    texts += ["", None, "\n", "x", "two words", "a b\\c </s>[INST] ü 漢字 \x1c  it's 123 ²½_ <|endoftext|> \r\n\t ok", "w" * 5000, " ".join(WORDS * 700)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 0, "r", "b", "k", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[0], None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return 1.0 if not a and not b else sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    sets = [multiset(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter(tuple(sorted(x, key=lambda v: (v is None, v))) for x in groups.values())


def test_neardup_classes_equal_brute_force(docs, empty):
    got = defaultdict(list)
    for r in bagminhash.near_duplicates(docs).collect():
        got[r.class_id].append(r.doc_id)
        assert r.class_id <= (r.exact_id if r.exact_id is not None else 10**9)
    assert Counter(tuple(sorted(x, key=lambda v: (v is None, v))) for x in got.values()) == brute_classes(make_docs())
    assert bagminhash.near_duplicates(empty).count() == 0


def test_neardup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(50)) for _ in range(30)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in texts]
    rows = [(None, t) for t in texts[:20]] + [(4, t) for t in texts[20:]] + [(100 + k, t) for k, t in enumerate(near)] + [(None, texts[0])] * 50
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = Counter((r.class_id, r.class_size) for r in got)
    assert len(got) == len(rows) and sum(n for (_, _), n in sizes.items()) == len(rows)
    assert sizes[(100, 52)] == 52 and all(sizes[(100 + k, 2)] == 2 for k in range(1, 20)) and sizes[(4, 2)] == 20


def test_neardup_finer_steps_and_exact_join_equal_brute_force(spark):
    # Chains of texts that share most of their words: buckets stay mixed after the pivots, so bands, sketches and pairs are all used.
    rng = random.Random(17)
    rows = []
    for g in range(6):
        base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(150)]
        for k in range(30):
            text = list(base)
            for _ in range(rng.randrange(1, 9)):
                text[rng.randrange(150)] = f"own{g}x{k}x{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(text)))
    want = brute_classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for exact in (False, True):
        got = defaultdict(list)
        for r in bagminhash.near_duplicates(df, exact=exact).collect():
            got[r.class_id].append(r.doc_id)
        assert Counter(tuple(sorted(x)) for x in got.values()) == want, exact
    # The exact join alone: no band, every pair of unlike parts.
    items = [(i, i, bagminhash.multiset_items(t)) for i, t in rows]
    frame = spark.createDataFrame(items, "id long, part long, items array<long>")
    links = bagminhash._verified(bagminhash.exact_links(frame, 0.8), frame.select("id", "items"), 0.8).collect()
    sets = {i: multiset(t) for i, t in rows}
    assert {(r.pa, r.pb) for r in links} == {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}


def test_neardup_on_small_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = defaultdict(list)
    for r in bagminhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        got[r.class_id].append(r.doc_id)
    assert Counter(tuple(sorted(x)) for x in got.values()) == brute_classes(rows)


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
    a[:10], b[50:] = 0, 0
    elements = bagminhash._mix(np.arange(60).astype(np.uint64))
    flat = [(d, elements[e], k) for d, counts in enumerate((a, b)) for e in np.argsort(elements) for k in range(counts[e])]
    sig = bagminhash.bag_signatures(np.array([x[0] for x in flat]), np.array([x[1] for x in flat], dtype=np.uint64), np.array([x[2] for x in flat]), 2, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5


def test_media_round_trip(docs, empty):
    texts = {r[0]: r[1] for r in make_docs()}
    for r in media.media_digests(media.store_texts(docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert len(pay) % 192 == 0 and len(pay) >= 192
    stored = media.store_texts(docs).select("doc_id", "n_bytes", media.index_media("media").alias("m")).collect()
    for r in stored:
        n = r.m.n_samples
        assert (r.m.codec, r.m.duration, len(r.m.keyframes)) == ("raw ", n * 192, -(-n // 8)) and all(k.end - k.start == 192 for k in r.m.keyframes)
    assert media.media_digests(media.store_texts(empty)).count() == 0


def test_media_rejects_broken_containers():
    payload = bytes(range(192)) * 40
    whole = media.write_container(payload)
    assert media.read_payload(whole) == payload
    t = media.tracks(whole)[0]
    assert all(whole[a : a + 192] == bytes(range(192)) for a in t.starts)
    assert media._index(whole[:100]) is None and media._index(None) is None and media._index(b"") is None
    assert media._index(box(b"moov") * 2) is None and media._index(b"not media at all, whatever it says") is None
    deep = b""
    for _ in range(5000):
        deep = box(b"moov", deep)
    assert media._index(deep) is None
    for name in (b"stsz", b"stts", b"stsc", b"stco", b"stss"):
        at = whole.index(name)
        for forged in (b"\xff\xff\xff\xff", b"\0\0\0\0"):
            for place in (8, 12):
                broken = whole[: at + place] + forged + whole[at + place + 4 :]
                assert broken == whole or (got := media._index(broken)) is None or got[3] <= len(whole)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, flags=0):
    return box(kind, struct.pack(">I", flags), *parts)


def numbers(*values):
    return struct.pack(f">{len(values)}I", *values)


def movie_track(number, codec, sizes, chunks, runs, times, sync, scale, kind=b"vide"):
    """A trak by hand: 32-bit headers, sizes in stsz or given as a box."""
    sized = sizes if isinstance(sizes, bytes) else full(b"stsz", numbers(0, len(sizes), *sizes))
    stbl = [full(b"stsd", numbers(1), box(codec, bytes(8))), full(b"stts", numbers(len(times) // 2, *times)), sized]
    stbl += [full(b"stsc", numbers(len(runs) // 3, *runs)), full(b"stco", numbers(len(chunks), *chunks))]
    if sync is not None:
        stbl.append(full(b"stss", numbers(len(sync), *sync)))
    mdia = box(b"mdia", full(b"mdhd", numbers(0, 0, scale, sum(times))), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", box(b"stbl", *stbl)))
    return box(b"trak", full(b"tkhd", numbers(0, 0, number, 0, 0)), mdia)


def test_media_reads_each_track_by_itself():
    # The first track has no stss, so all its samples are sync samples; the second has 8-bit sizes in stz2 and one sync sample.
    data = b"abcdefghijklmnopqrstuvwxyz"
    stz2 = full(b"stz2", numbers(8, 3), bytes([2, 3, 4]))
    four = full(b"stz2", numbers(4, 3), bytes([0x23, 0x40]))
    base = 8
    one = movie_track(1, b"mp4a", [1, 2, 3, 4], [base, base + 20], [1, 3, 1, 2, 1, 1], [4, 5], None, 100, b"soun")
    two = movie_track(7, b"avc1", stz2, [base + 6], [1, 3, 1], [1, 10, 2, 20], [2], 1000)
    file = box(b"mdat", data) + box(b"moov", full(b"mvhd", bytes(96)), one, two)
    a, b = media.tracks(file)
    assert (a.track_id, a.kind, a.codec, a.timescale, a.duration, a.sync.tolist()) == (1, "soun", "mp4a", 100, 20, [0, 1, 2, 3])
    assert media.read_payload(file, a) == b"abcdef" + b"uvwx" and a.keyframes()[3] == (base + 20, base + 24)
    assert (b.track_id, b.codec, b.duration, b.keyframes()) == (7, "avc1", 50, [(base + 8, base + 11)]) and media.read_payload(file, b) == b"ghijklmno"
    index = media._index(file)
    assert index[0] == "mp4a" and [r[0] for r in index[5]] == [1, 7] and index[5][1][6] == [(base + 8, base + 11)]
    nibbles = box(b"mdat", data) + box(b"moov", movie_track(7, b"avc1", four, [base], [1, 3, 1], [3, 1], [1], 10))
    assert media.tracks(nibbles)[0].sizes.tolist() == [2, 3, 4]
    empty = box(b"moov", movie_track(1, b"avc1", [], [], [], [], None, 10))
    assert media.read_payload(empty) == b"" and media._index(empty)[3] == 0
    # Fragments: sizes, durations and flags from runs, or from trex where runs have none.
    trex = box(b"mvex", full(b"trex", numbers(1, 1, 7, 2, media.NOT_SYNC)))
    moov = box(b"moov", movie_track(1, b"avc1", [], [], [], [], None, 10), trex)
    def moof(offset):
        runs = full(b"trun", numbers(3, offset), numbers(0), numbers(4), numbers(5), flags=0x201 | 4)[:0]
        runs = full(b"trun", numbers(2, offset, 0, 3, 4), flags=0x205) + full(b"trun", numbers(2))
        return box(b"moof", box(b"traf", full(b"tfhd", numbers(1), flags=0x20000), runs))
    frag = moov + moof(len(moof(0)) + 8) + box(b"mdat", data)
    t = media.tracks(frag)[0]
    assert media.read_payload(frag) == b"abc" + b"defg" + b"hi" + b"jk" and t.duration == 28 and t.sync.tolist() == [0]


def naive_phrases(text):
    known, w = set(), ""
    for c in text:
        w += c
        if w not in known:
            known.add(w)
            w = ""
    return known


def test_lz_pairs_equal_brute_force(docs, empty):
    rows = sorted(((r[0], r[1] or "") for r in make_docs()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got = sorted((tuple(r) for r in lz.edited_fingerprints(docs).collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        prints = [lz.signature(naive_phrases(x)) for x in (text, edited, after)]
        want = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0].tobytes().hex(), prints[1].tobytes().hex(), lz.likeness(*prints[:2]), lz.likeness(prints[0], prints[2]))
        if rows.count((doc_id, text)) == 1:
            assert got[k] == want
    assert lz.edited_fingerprints(empty).count() == 0


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(20):
        n, m = rng.randrange(1, 6), rng.randrange(1, 7)
        old = {i: rng.randrange(0, 50) for i in range(n)}
        cap = [sum(old.values()) * (j + 1) // m - sum(old.values()) * j // m for j in range(m)]
        plan = reshard.transfers(old, m)
        stays = sum(x for i, moves in plan.items() for j, x in moves if i == j)
        assert stays == sum(min(old.get(j, 0), cap[j]) for j in range(m))
        assert all(sum(x for _, x in plan[i]) == old[i] for i in old) and [sum(x for moves in plan.values() for j, x in moves if j == k) for k in range(m)] == cap


def test_reshard_is_whole_even_and_gapless(docs, empty, spark, tmp_path):
    rows = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in make_docs()]
    got = reshard.reshard(docs, new_shards=4, old_shards=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    total, most = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in by[s]) - total / 4) <= 2 * most for s in range(4))
    assert reshard.reshard(empty).count() == 0
    unique = docs.where("doc_id IS NOT NULL AND n_chars < 2000").dropDuplicates(["doc_id"])
    placed = reshard.reshard(unique, new_shards=4, old_shards=3)
    affected = reshard.rewrite(unique, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert affected and {(r.doc_id, r.text) for r in back.select("doc_id", "text").collect()} == {(r.doc_id, r.text) for r in unique.collect()}


def test_rewrite_keeps_odd_rows_and_untouched_shards(docs, spark, tmp_path):
    rows = [(*r[:2], k % 3, k) for k, r in enumerate([*[r for r in make_docs() if len(r[1] or "") < 2000], *[(None, f"text {k % 2}") for k in range(6)], *[(5, "same")] * 4])]
    own = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int").repartition(3)
    lies, path = F.col("shard"), str(tmp_path / "shards")
    placed = reshard.reshard(own, old_shard=lies, new_shards=4).cache()
    own.where("doc_id = 9").withColumn("_slot", F.lit(0)).withColumn("_shard", F.lit(9)).write.partitionBy("_shard").parquet(path)
    affected = reshard.rewrite(own, placed, path, old_shard=lies)
    back = spark.read.parquet(path)
    assert [r.doc_id for r in back.where("_shard = 9").collect()] == [9]
    got = back.where("_shard < 9").collect()
    assert affected == [0, 1, 2, 3] and Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter(rows)
    assert Counter((r.doc_id, r._shard, r._slot) for r in got) == Counter((r.doc_id, r.shard, r.slot) for r in placed.collect())


def test_resharded_rows_are_read_back_from_the_shards(docs, empty, spark, tmp_path):
    path = str(tmp_path / "shards")
    docs, rows = docs.where("length(coalesce(text, '')) < 2000"), [r for r in make_docs() if len(r[1] or "") < 2000]
    got = reshard.resharded(docs, path, new_shards=4, old_shards=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, reshard.reshard(docs, new_shards=4, old_shards=3).collect()))
    back = spark.read.schema(docs.schema).parquet(path)
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(rows)
    assert reshard.resharded(empty, str(tmp_path / "none")).count() == 0
    # A shard that loses all its rows goes; one whose rows all stay has no folder.
    two = spark.createDataFrame([(0, "a" * 9, 1), (1, "b" * 9, 0), (2, "c" * 9, 2)], "doc_id long, text string, lies int")
    stay = reshard.resharded(two.where("lies < 2"), str(tmp_path / "stay"), old_shard=F.col("lies"), new_shards=2)
    assert sorted((r.doc_id, r.shard) for r in stay.collect()) == [(0, 1), (1, 0)] and not (tmp_path / "stay").exists()
    two.withColumn("shard", F.col("lies")).write.partitionBy("shard").parquet(str(tmp_path / "less"))
    less = reshard.resharded(two, str(tmp_path / "less"), old_shard=F.col("lies"), new_shards=2)
    assert sorted(r.doc_id for r in less.collect()) == [0, 1, 2] and not (tmp_path / "less" / "shard=2").exists()


def test_resharding_query_writes_the_texts(spark, sf, monkeypatch, tmp_path):
    from vellum.llm.queries import QUERIES

    monkeypatch.setattr(reshard, "scratch", lambda _: str(tmp_path / "shards"))
    got = QUERIES["op4_flow_resharding"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    affected = {s for r in got if r.moved for s in (r.old_shard, r.shard)}
    texts = {r.doc_id: r.text for r in docs}
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert len(got) == len(docs) == len(texts) and affected
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back) == Counter((r.doc_id, texts[r.doc_id], r.shard, r.slot) for r in got if r.shard in affected)


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(documents.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9 and np.mean([x < 0.7 for x in clean]) > 0.98
    none = toxicity.scored(documents.limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and all(r.predicted == 0 for r in none)


def test_toxicity_learns_words_it_was_not_told(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + (f" grobian{rng.choice('abcdef')}" if i % 5 == 0 else "")) for i in range(300)]
    documents = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(documents, labels).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300)) and got[900].predicted == got[901].predicted == 0


def test_toxicity_counts_repeated_rows_once_and_keeps_clashing_columns(spark):
    rng = random.Random(3)
    rows = [(i % 20, " ".join(rng.choice(WORDS) for _ in range(10)) + (" grobian" if i % 20 < 8 else "")) for i in range(200)]
    documents = spark.createDataFrame([(*r, 1, 2, None, "x") for r in rows], "doc_id long, text string, i int, y int, score string, id_ string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(20)] + [(3, 0)], "doc_id long, toxic int")
    got = toxicity.scored(documents, labels).collect()
    assert len(got) == 200 and all(r.score is not None and 0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert all((r.i, r.y, r.id_) == (1, 2, "x") for r in got)
    assert toxicity.scored(documents.limit(0), labels).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    one, two = (rng.random(4000) < np.where(y, 0.8, 0.05) for _ in range(2))
    votes = np.stack([one, one, one, two, ~(one | two)], axis=1)
    post, acc, corr, prior = toxicity.label_model(votes, np.array([[0.1, 0.7]] * 4 + [[0.9, 0.3]]), 0.2)
    assert corr[0, 1] > 0.5 and corr[0, 3] < 0.5 and 0.1 < prior < 0.35 and ((post > 0.5) == y).mean() > 0.8


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be"), (1, 1, "user", "</s>[INST] \\ [/INST]"), (1, 2, "assistant", "<|over|>\\"), (2, None, None, None), (2, 5, "assistant", ""), (None, 0, "assistant", "x"), (3, 1, "b", "2"), (3, 1, "a", "1")]
    turns += [(4, k, "user" if k % 2 == 0 else "assistant", f"say {k} <|turn|>") for k in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    by = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    got = chat.format_chats(df.unionByName(chat.probe(spark)), digests=True).collect()
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        loss = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(by[r.conv_id]), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id]).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.rewrites_history) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [chat.unescape(whole[1].formatted[t.start : t.end]) for t in whole[1].turns] == [t for _, t in by[1]]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_detects_rewritten_history(spark):
    turns = [("user", str(k)) for k in range(20)]
    assert chat.spans(turns, lambda ts: f"{len(ts)}:" + chat.template(ts))[1] is None
    counted = lambda ts: "".join(f"<{i}>{t}" for i, (_, t) in enumerate(ts))  # noqa: E731  far history matters, and is not rewritten
    text, found = chat.spans(turns, counted)
    assert [text[a:b] for a, b in found] == [f"<{i}>{i}" for i in range(20)]
    # Only one prefix, the tenth, is told otherwise; its turns can still be read from the whole output.
    tenth = lambda ts: chat.template(ts) if len(ts) != 10 else "!" + chat.template(ts)
    assert all(chat.spans(turns[:n], tenth)[1] is None for n in range(10, 20)) and chat.spans(turns[:9], tenth)[1] is not None
    df = spark.createDataFrame([(1, k, *turn) for k, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (got,) = chat.format_chats(df, render=tenth).collect()
    assert got.rewrites_history and [chat.unescape(got.formatted[t.start : t.end]) for t in got.turns] == [t for _, t in turns]
    (got,) = chat.format_chats(df.where("turn < 9"), render=tenth).collect()
    assert not got.rewrites_history and len(got.turns) == 9


def test_bpe_equals_the_library(docs, empty):
    enc = bpe.encoding(bpe.public_tokenizers.path(bpe.RANKS))
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), r[1] or "") for r in make_docs())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_texts(docs).collect()) == want
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs, digests=True).collect()}
    assert got == {(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in want}
    assert bpe.encode_texts(empty).count() == 0


def test_pretokens_equal_the_pattern():
    import public_tokenizers
    import regex

    from vellum.llm.pretokens import splitter

    rng, split = random.Random(4), splitter()
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(384), rng.randrange(0x3000), 32, 39, 10, ord("s")])) for _ in range(rng.randrange(30)))
        assert split(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_token_counts_equal_the_library(docs, empty):
    tokenizer, proven, _ = tokencount.prove(tokencount.public_tokenizers.path(tokencount.VOCABULARY))
    assert len(proven) > 40_000
    want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in make_docs())
    got = tokencount.token_counts(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokencount.token_counts(empty).count() == 0


def brute_lines(rows, min_docs=3):
    key = lambda s: re.sub(r"[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    of = lambda i: -(2**63) if i is None else i
    seen = defaultdict(set)
    for r in rows:
        for s in (r[1] or "").split("\n"):
            if len(key(s)) >= 20:
                seen[key(s)].add(of(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [s for s in lines if not (len(seen.get(key(s), ())) >= min_docs and max(seen[key(s)]) != of(r[0]))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup_equals_brute_force(docs, empty, spark):
    got = linededup.dedup_lines(docs, with_text=True).collect()
    assert Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute_lines(make_docs())
    assert all(linededup.unpack(r.keep, r.n_lines).sum() == r.n_lines - r.n_dropped for r in got)
    assert sum(r.n_dropped for r in got) > 5 and linededup.dedup_lines(empty).count() == 0
    rng = random.Random(1)
    common = ["a very common line of text %d" % k for k in (0, 0, 0, 0, 0, 1, 1, 2)] + ["rather short"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.7 else f"a line of its own, number {rng.random()}" for _ in range(rng.randrange(1, 9)))) for i in range(600)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(many, with_text=True).collect()) == brute_lines(rows)


def test_mix_meets_its_targets(docs, empty):
    rows = make_docs()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        if not (over := [s for s in rest if level * weight[s] > 3 * size[s]]):
            break
        capped |= {s: 3.0 * size[s] for s in over}
    target = {s: capped.get(s, level * weight[s]) for s in names}
    got = wfq.mixed_sizes(docs).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == Counter((r[0], r[3], words(r[1]), size[r[3]]) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-5
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in names)
    assert Counter(map(tuple, got)) == Counter(map(tuple, wfq.mixed_sizes(docs.repartition(2)).collect()))
    sent = sorted(wfq.mix(docs).collect(), key=lambda r: r.place)
    assert [r.place for r in sent] == np.cumsum([0] + [r.taken for r in sent])[:-1].tolist() and all(a.finish <= b.finish for a, b in zip(sent, sent[1:]))
    assert wfq.mixed_sizes(empty).count() == 0 and wfq.mix(empty).count() == 0


def test_pipeline_stages(spark, docs, empty, sf):
    import corpus_pipeline

    own = docs.select(*corpus_pipeline.COLUMNS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (own, empty.select(*corpus_pipeline.COLUMNS)):
            out = stage(spark, frame, sf)
            if k < 4:
                assert out.columns == corpus_pipeline.COLUMNS, name
            assert (out.count() > 0) == (frame is own)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, own, sf).collect()}
    assert len(kept) == len(brute_classes(make_docs()))
    assert corpus_pipeline.drop_toxic(spark, own, sf).count() == own.count()


def test_pipeline_keeps_a_row_of_every_class_whatever_its_id(spark):
    import corpus_pipeline

    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)) for _ in range(9)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    # Null ids with unlike texts, one id with unlike texts, a near copy of the null-id text under that id, equal rows, null and empty texts.
    pairs = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(7, near), (7, near), (8, texts[5]), (1, texts[7]), (1, texts[8]), (None, None), (None, ""), (1, "")]
    own = spark.createDataFrame([(i, t, f"l{k}", f"s{k}", len(t or "")) for k, (i, t) in enumerate(pairs)], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter([(None, t) for t in texts[1:4]] + [(7, t) for t in texts[4:7]] + [(7, near), (1, texts[7]), (1, texts[8]), (1, "")])
    for frame in (own.repartition(1), own.repartition(3)):
        kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
        assert Counter((r.doc_id, r.text) for r in kept) == want
        assert [(r.lang, r.source) for r in kept if r.text == near] == [("l7", "s7")]


def test_pipeline_runs_whole(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() <= n and out.where("n_tokens IS NULL").count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    from vellum.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet')")
    for name, sql in SQL.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = QUERIES[name](spark, d)
        assert sorted(columns) == sorted(got.columns)
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall()), name
