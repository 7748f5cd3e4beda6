"""Every corpus operator against a brute-force version, on whole small tables with awkward rows."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from factloom.llm import bwt_merge, common, mixing, mpeg_audio, near_dedup, packing, pii, quality_classifier, quality_rules, repeats, token_files, tokens, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, word string, features string, size string, ids string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=7, n=120):
    """Texts with copies, near copies, shared passages, odd characters, empty, null, very long ones and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiklmnorstuv") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, out = text(90), []
    for i in range(n):
        out.append(text(rng.randint(1, 160)))
    out += [out[3]] * 5 + [passage + " " + text(60), text(30) + " " + passage, text(9) + "\n" + passage + "\n" + text(4)]
    for k in (10, 11, 12, 13):
        for _ in range(4):
            words = out[k].split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
    out += ["", " \n\t ", None, "one", "One", "two words", "zwölf Boxkämpfer jagen Viktor　quer über\x85den Sylter Deich " * 30, "a" * 3000, "ab" * 900, "x y " * 800, "日本語 " * 40, "A\x1cB\x0bC"]
    out += [f"{text(20)} mail me: a{i}@mail{i}.example.com or +1 (555) 010-2{i:03d} 4111 1111 1111 1111 at 10.0.0.{i}" for i in range(4)]
    out.append(" ".join(rng.choice(vocab) for _ in range(20000)))
    rows = [(i, t, [None, "en", "de"][i % 3 if i % 17 else 0], [None, "b", "a", "c"][i % 4 if i % 2 else 1], len(t or ""), "k", "w", "f", "s", "i") for i, t in enumerate(out)]
    return rows + [rows[5], rows[-1]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    caps = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines), caps, text.count("!")


def test_quality_counts(rows):
    for r in rows:
        assert quality_rules.counts((r[1] or "").encode()) == counts(r[1])


def bucket(v):
    return v if v < 64 else (v.bit_length() - 6) * 32 + (v >> (v.bit_length() - 6))


def top(b):
    return b if b < 64 else (((b - 32) % 32 + 33) << ((b - 32) // 32)) - 1


def brute_rules(rows, min_docs):
    measured = []
    for r in rows:
        c = dict(zip(quality_rules.COUNTS, counts(r[1]), strict=True))
        measured.append((r[2], r[3], c, {m: h[2] * c[h[0]] // c[h[1]] if c[h[1]] else 0 for m, h in quality_rules.MEASURES.items()}))
    def quantile(group, m, percent):
        buckets = sorted(bucket(x[3][m]) for x in group)
        return top(buckets[-(-len(buckets) * percent // 100) - 1])
    def fence(m, own, lang):
        q50, q75 = (quantile(own, m, q) for q in (50, 75))
        return 10 + max(q75 + 6 * (q75 - q50), quality_rules.MEASURES[m][3] * quantile(lang, m, 99) // 100)
    out = []
    for r, (lang, source, c, v) in zip(rows, measured, strict=True):
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        ok = not failed
        own, wide = [x for x in measured if x[:2] == (lang, source)], [x for x in measured if x[0] == lang]
        wide = wide if len(wide) >= min_docs else measured
        own = own if len(own) >= min_docs else wide
        ok = ok and all(v[m] <= fence(m, own, wide) for m in quality_rules.MEASURES)
        out.append((r[0], *list(c.values())[:5], failed, ok))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [1, 30, 10**6])
def test_quality_rules(spark, docs, rows, none, min_docs, monkeypatch):
    assert got(quality_rules.quality_rules(spark, docs, min_docs)) == brute_rules(rows, min_docs)
    if min_docs == 30:
        kept = [x[0] for x in brute_rules(rows, min_docs) if x[-1]]
        named = docs.withColumn("base_failed", F.lit("mine"))
        out = quality_rules.filter_quality(spark, named, min_docs)
        assert out.columns == named.columns and {r.base_failed for r in out.collect()} == {"mine"}
        out = quality_rules.filter_quality(spark, docs, min_docs)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the salted join
        assert got(quality_rules.quality_rules(spark, docs, min_docs)) == brute_rules(rows, min_docs)
        assert quality_rules.quality_rules(spark, none).count() == 0


def test_bucket_columns(spark):
    values = [*range(300), 1000, 4095, 4096, 123456, 2**31, 2**40 + 12345]
    b, t = quality_rules.bucket(F.col("v")), quality_rules.bucket_top(quality_rules.bucket(F.col("v")))
    for v, x, y in spark.createDataFrame([(v,) for v in values], "v long").select("v", b, t).collect():
        assert x == bucket(v) and y == top(x) and v <= y <= v * 33 / 32 + 1


def test_classifier(spark, docs, rows, none):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "river", "stone", "walks", "under"]) for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY", "NOW!!", "###", "$$$", "click"]) for _ in range(60)) for _ in range(300)]
    given = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad, "", None])], "doc_id long, text string")
    labels = [(i, int(i < 300), 0) for i in range(600)]
    poisoned = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, 0) for i, q, _ in labels]  # held-out labels must not matter
    a, b = (quality_classifier.quality_classifier(spark, given, spark.createDataFrame([*x, (5, None, 0)], "doc_id long, quality int, toxic int")) for x in (labels, poisoned))
    out = {r.doc_id: r for r in a.collect()}
    assert out == {r.doc_id: r for r in b.collect()}
    held = [r for i, r in out.items() if r.held_out and i < 600]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.98
    assert out[600].score == out[601].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.quality_classifier(spark, docs, empty).collect()} == {0.5}
    assert quality_classifier.quality_classifier(spark, none, empty).count() == 0


def test_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality_classifier.fit(x, y)
    for i in range(0, 500, 50):
        raw = m.start
        for f, t, v in zip(m.feature, m.threshold, m.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > t[node])
            raw += v[node - len(f)]
        assert np.isclose(m.score(x[i : i + 1])[0], 1 / (1 + np.exp(-raw)))
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_mpeg(spark, docs, rows, none):
    out = {r.doc_id: r for r in mpeg_audio.audio_columns(spark, docs).collect()}
    for r in rows:
        text, o = (r[1] or "").encode(), out[r[0]]
        pay = text + b" " * (192 - len(text) % 192 if len(text) % 192 or not text else 0)
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(text), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert o.gaps == 0 and o.bad_crc == 0 and o.samples == 1152 * len(o.seek_offsets)
        media = mpeg_audio.wrap(pay)
        assert o.media_bytes == len(media) and o.media_sha256 == hashlib.sha256(media).hexdigest()
    assert mpeg_audio.audio_columns(spark, none).count() == 0


def test_mpeg_damage():
    media = mpeg_audio.wrap(mpeg_audio.padded(b"payload " * 1000))
    whole, _ = mpeg_audio.parse(media)
    assert whole.table == "Xing" and whole.table_frames == len(whole.offsets) and len(whole.seeks) == 100 and whole.table_faults == [] and whole.tags["payload_bytes"] == "8064"
    cut, _ = mpeg_audio.parse(media[:1500] + media[1550:])
    assert cut.gaps > 0 and len(cut.offsets) == len(whole.offsets) - 1
    i = whole.offsets[2]
    flipped, _ = mpeg_audio.parse(media[: i + 10] + b"\x40" + media[i + 11 :])
    assert flipped.bad_crc == 1 and len(flipped.offsets) == len(whole.offsets)
    assert mpeg_audio.parse(b"no audio here" * 20)[0].offsets == [] and mpeg_audio.parse(b"")[0].seconds == 0
    assert mpeg_audio.parse(b"\xff" * 5000)[0].offsets == []


def _slow_crc(bits: str) -> int:
    """CRC-16 as the remainder of a division of bit strings."""
    value = int(bits, 2) << 16 ^ 0xFFFF << len(bits)
    for k in range(len(bits) - 1, -1, -1):
        if value >> k + 16 & 1:
            value ^= 0x18005 << k
    return value


@pytest.mark.parametrize(
    ("word", "widths", "layer"),
    [
        (0xFFFE_5400, [4] * 64, 1),  # 48 kHz, two channels
        (0xFFFE_5440, [4] * 8 + [4] * 28, 1),  # joint from subband 4: pairs below it, then one each
        (0xFFFC_A400, [4] * 22 + [3] * 24 + [2] * 8, 2),  # 192 kbit/s, 48 kHz: table a
        (0xFFFC_C000, [4] * 22 + [3] * 24 + [2] * 14, 2),  # 256 kbit/s, 44.1 kHz: table b
        (0xFFFC_20C0, [4] * 2 + [3] * 6, 2),  # 48 kbit/s, one channel, 44.1 kHz: table c
        (0xFFFC_28C0, [4] * 2 + [3] * 10, 2),  # the same at 32 kHz: table d
        (0xFFF4_84C0, [4] * 4 + [3] * 7 + [2] * 19, 2),  # lower rates
        (0xFFFC_A460, [4] * 22 + [3] * 2 + [3] * 11 + [2] * 4, 2),  # joint from subband 12
    ],
)
def test_mpeg_crc_of_layers_one_and_two(word, widths, layer):
    rng = random.Random(word)
    h = mpeg_audio.header(word)
    assert h and h.layer == layer and h.protected
    frames = []
    for _ in range(20):
        allocations = [rng.choice([0, rng.randrange(1 << w)]) for w in widths]
        pairs = 2 * h.joint if h.joint < 32 else len(widths)
        chosen = sum((1 if k < pairs else 2) for k, v in enumerate(allocations) if v) if layer == 2 else 0
        bits = "".join(f"{v:0{w}b}" for v, w in zip(allocations, widths, strict=True)) + "".join(rng.choice("01") for _ in range(2 * chosen))
        crc = _slow_crc(f"{word & 0xFFFF:016b}" + bits)
        body = "".join(rng.choice("01") for _ in range(8 * (h.size - 6) - len(bits)))
        frames.append(word.to_bytes(4, "big") + crc.to_bytes(2, "big") + int(bits + body, 2).to_bytes(h.size - 6, "big"))
    got, _ = mpeg_audio.parse(b"".join(frames))
    assert (len(got.offsets), got.checked, got.bad_crc) == (20, 20, 0)
    frames[3] = frames[3][:6] + bytes([frames[3][6] ^ 0x80]) + frames[3][7:]
    assert mpeg_audio.parse(b"".join(frames))[0].bad_crc == 1


def test_mpeg_tables():
    media = mpeg_audio.wrap(mpeg_audio.padded(b"table " * 40_000))
    whole, _ = mpeg_audio.parse(media)
    at, n = whole.table_at, len(whole.offsets)
    assert whole.table_bytes == whole.end - at and [k for k, _ in whole.seeks] == [i * n // 100 for i in range(100)]
    fewer, _ = mpeg_audio.parse(media[: whole.offsets[100]] + media[whole.offsets[150] :])
    assert fewer.table_faults == ["frames", "bytes", "seek"] and "wrong frames wrong bytes wrong seek" in mpeg_audio.feature(fewer)
    # a table of the other kind, with one point for every 20 frames, in units of 4 bytes
    frames = [media[a : a + 960] for a in whole.offsets[:60]]
    points = b"".join((20 * 960 // 4).to_bytes(2, "big") for _ in range(3))
    head = media[at : at + 4]
    vbri = (head + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 960 * 60 + 240, 60, 3, 4, 2, 20) + points).ljust(240, b"\0")
    got, _ = mpeg_audio.parse(vbri + b"".join(frames))
    assert (got.table, got.table_frames, got.table_bytes, got.table_faults) == ("VBRI", 60, 57840, [])
    assert got.seeks == [(0, 240), (20, 240 + 19200), (40, 240 + 38400), (60, 57840)] and got.offsets[20] == got.seeks[1][1]
    # an encoder's delay and padding after the table
    trim = media[at : at + 240]
    p = trim.index(b"Xing") + 116
    trim = trim[:p] + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big") + trim[p + 24 :]
    got, _ = mpeg_audio.parse(media[:at] + trim + media[at + 240 :])
    assert got.trim == (576, 1000) and got.played == got.samples - 1576 == whole.played - 1576


def brute_near(rows, width):
    sets = []
    for r in rows:
        words = SPACE.findall("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    up = list(range(len(rows)))
    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return sorted(((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, rows, none, width, monkeypatch):
    assert got(near_dedup.near_duplicates(spark, docs, width)) == brute_near(rows, width)
    assert near_dedup.near_duplicates(spark, none, width).count() == 0
    out = near_dedup.drop_near_duplicates(spark, docs, width)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({x[0] for x in brute_near(rows, width) if x[3]})


def test_near_duplicates_of_chains_and_small_sets(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(60):  # a chain: each differs a little from the one before
        base[(i * 7) % 120] = f"new{i}"
        texts.append(" ".join(base))
    small = ["p q r s t u v".split()[: rng.randint(2, 7)] for _ in range(80)]
    texts += [" ".join(s if rng.random() < 0.5 else [*s, rng.choice("xyz")]) for s in small]
    rows = [(i, t) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, hubs in ((100, 2), (1, 0), (1, 2)):  # the last two: all work falls to lists of full sets
        monkeypatch.setattr(near_dedup, "HOT", hot)
        monkeypatch.setattr(near_dedup, "HUB_ROUNDS", hubs)
        assert got(near_dedup.near_duplicates(spark, given, 2)) == brute_near(rows, 2)


def family_of(spark, ws, sets):
    """(classes, family, comps, sets) of shingle sets as texts of one-word shingles; node 0 is the hub of all others."""
    texts = [(i, " ".join(x)) for i, x in enumerate(sets)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = ws.stage(near_dedup.sketch_documents(docs, 1).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "digest", "sketch"))
    family = spark.createDataFrame([(i, 0) for i in range(1, len(sets))], "node long, hub long")
    return classes, family, spark.createDataFrame([], "node long, comp long"), near_dedup._Sets(ws, docs, classes, 1)


def family_links(spark, sets):
    """(links among a family's candidate pairs, its links by brute force)."""
    with common.Workspace(spark, "test") as ws:
        classes, family, comps, full = family_of(spark, ws, sets)
        full.of(classes.select("node"))
        pairs = near_dedup._ordered(near_dedup._family_pairs(ws, family, comps, full), None).collect()
    alike = lambda a, b: len(a & b) * 100 >= 80 * len(a | b)
    sets = [set(x) for x in sets]
    want = {(i, j) for j in range(1, len(sets)) for i in range(1, j) if alike(sets[i], sets[j])}
    return {(r.x, r.y) for r in pairs if alike(sets[r.x], sets[r.y])}, want


def variants(rng, n, cut, own, count):
    """A hub of n words and count pairs of variants: cut words of the hub are replaced alike in a pair, then own in each."""
    hub = [f"h{i}" for i in range(n)]
    out = [hub]
    for g in range(count):
        at = rng.sample(range(n), cut + 2 * own)
        for k in range(2):
            words = list(hub)
            for i in at[:cut]:
                words[i] = f"g{g}x{i}"
            for i in at[cut + k * own : cut + (k + 1) * own]:
                words[i] = f"o{g}x{k}x{i}"
            out.append(words)
    return out


@pytest.mark.parametrize("n, cut, own", [(60, 7, 2), (1500, 200, 60), (5000, 700, 200)])
def test_family_pairs_lose_no_link(spark, n, cut, own):
    links, want = family_links(spark, variants(random.Random(n), n, cut, own, 4))
    assert len(want) == 4 and links == want


def test_few_links_are_gathered(spark, monkeypatch):
    """Components on the driver and by rounds on tables are the same; small inputs do not take a task per shuffle partition at every step."""
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(50)]
    with common.Workspace(spark, "test") as ws:
        found = {}
        for few in (0, 10_000):
            monkeypatch.setattr(near_dedup, "FEW_PAIRS", few)
            half = [spark.createDataFrame(links[i::2], "x long, y long") for i in (0, 1)]
            comps = near_dedup._grown(ws, near_dedup._grown(ws, None, half[0]), half[1])
            found[few] = sorted(tuple(r) for r in comps.collect())
    assert found[0] == found[10_000] and len(found[0]) > 200 and all(n > c for n, c in found[0])

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:20], f"v{i}", *words[20:40], f"u{i % 7}"])) for i in range(80)] + [(100 + i, f"a{i} b{i} c{i}") for i in range(20)]
    given, tasks = spark.createDataFrame(rows, "doc_id long, text string"), 0
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few", "few")
        out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, given, 1).collect()}
        tracker = spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup("few"):
            tasks += sum(info.numCompletedTasks for s in tracker.getJobInfo(job).stageIds if (info := tracker.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(out[i] == (0 if i < 80 else i) for i in out)
    assert tasks < 800


def test_foreign_pairs_lose_no_link(spark):
    words = [f"w{i}" for i in range(60)]
    sets = [words, *([*words[:58], *(f"v{i}x{k}" for k in range(2))] for i in range(12))]
    hubs = [None, 20, 20, 20, 20, 20, 20, 21, 21, 21, None, None, None]
    with common.Workspace(spark, "test") as ws:
        listed = [(key, i, i, 60, key - 1, h) for key in (1, 2) for i, h in enumerate(hubs)]
        listed = spark.createDataFrame(listed, "key long, node long, comp long, n long, at long, hub long")
        pairs = near_dedup._ordered(near_dedup._foreign_pairs(ws, listed), None).collect()
    want = {(i, j) for j in range(13) for i in range(j) if hubs[i] is None or hubs[i] != hubs[j]}
    assert {(r.x, r.y) for r in pairs} == want


@pytest.mark.parametrize("n, cut, own", [(60, 7, 2), (1500, 200, 60)])
def test_near_duplicates_of_variants(spark, n, cut, own, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 3)  # the group's lists are large ones
    sets = [x for g in range(2) for x in variants(random.Random(n + g), n, cut, own, 6)[g:]]  # two groups, one with its hub
    rows = [(i, " ".join(x)) for i, x in enumerate(sets)]
    got_ = got(near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 1))
    assert got_ == brute_near(rows, 1) and len({r[2] for r in got_}) < len(rows)


@pytest.mark.parametrize("hub", [True, False])
def test_candidates_of_a_large_group_stay_few(spark, hub, monkeypatch):
    rng, n, m = random.Random(5), 150, 2000
    core = [f"c{i}" for i in range(n)]
    rows = [(0, " ".join(core))] if hub else []
    for i in range(1, m):  # similar to each other at about 0.7; those of 19 changes are not linked with the core either
        words, at = list(core), rng.sample(range(n), 13 if i % 2 else 19)
        for j in at:
            words[j] = f"o{i}x{j}"
        rows.append((i, " ".join(words)))
    judged, verify = [], near_dedup._verify

    def counted(ws, pairs, *more, **options):
        judged.append(pairs.count())
        return verify(ws, pairs, *more, **options)

    monkeypatch.setattr(near_dedup, "_verify", counted)
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, given, 1).collect()}
    assert component == {i: 0 if hub and i % 2 else i for i, _ in rows}  # 137 of 163 are common with the core, or 131 of 169
    assert sum(judged) < 20 * m  # of 2 million pairs


def test_drop_near_duplicates_with_null_and_repeated_ids(spark, rows):
    given = [(None if i % 3 == 0 else i % 25 if i % 3 == 1 else x[0], *x[1:]) for i, x in enumerate(rows)]
    assert len({x[0] for x in given}) < len(given) / 2
    of, ids, parts = {}, defaultdict(list), brute_near([(i, x[1]) for i, x in enumerate(given)], 5)
    for i, _, least, _ in parts:
        of[given[i][1]] = least if (given[i][1] or "").split() else None
        ids[least].append(given[i][0])
    least_ids = [min((x for x in v if x is not None), default=None) for v in ids.values()]
    out = near_dedup.drop_near_duplicates(spark, spark.createDataFrame(given, SCHEMA).repartition(5), 5).collect()
    assert Counter(r.doc_id for r in out) == Counter(least_ids)
    assert all(tuple(r) in given for r in out)
    assert max(Counter(c for r in out if (c := of[r.text]) is not None).values()) == 1


def test_family_pairs_share_hot_differences_only(spark):
    rng = random.Random(9)
    hub, sets = [f"h{i}" for i in range(70)], []
    for _ in range(150):  # few places of change, so nearly every difference is shared by many
        at = set(rng.sample(range(12), rng.randint(7, 9)))
        sets.append([f"c{i}" if i in at else w for i, w in enumerate(hub)])
    for i in range(0, 150, 3):  # with own differences between the shared ones
        sets[i] = [f"o{i}x{k}" if 20 <= k < 20 + i % 7 else w for k, w in enumerate(sets[i])]
    links, want = family_links(spark, [hub, *sets])
    assert len(want) > 1000 and links == want


def test_packing(spark, docs, rows, none):
    path = P.path("byte_bpe_50k.json")
    out = packing.pack(spark, docs, path, with_ids=True)
    library = tokens.encoder(path).library
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    copies = Counter(r[0] for r in rows)
    for r in {r[0]: r for r in rows}.values():
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in by_doc[r[0]]) == sorted(want * copies[r[0]])
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= -(-total // 1024) + 1
    assert sum(len(r.ids) for r in packing.sequences(out).collect()) == 4 * total
    assert packing.pack(spark, none, path).count() == 0


def test_best_two_fit_replaces_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]
    plan = packing.best_two_fit({7: 10**9, 3: 10**9, 5: 3}, 10)
    assert plan[0] == ((7, 3), 10**9) and len(plan) <= 3


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.targets([1, 100, 100], [3, 1, 1]) == [3.0, 99.0, 99.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 6], [1, 2]) == [0.0, 6.0]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1023, 5000])
def test_permutation(n):
    for k in (0, 17, 10**12):
        p = mixing.permute(np.arange(n), n, k)
        assert sorted(p) == list(range(n))
        if n > 1:
            assert all(p[mixing._place_of(v, n, k)] == v for v in (0, n // 2, n - 1))


@pytest.mark.parametrize("block", [1, 64, 512])
def test_mixing(spark, docs, rows, none, block):
    out = mixing.mix_report(spark, docs, block, shard_slots=8)
    again = mixing.mix_report(spark, docs.repartition(2), block, shard_slots=8)
    assert got(out) == got(again)
    size = {i: len(SPACE.findall(r[1] or "")) for i, r in enumerate(rows)}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = [sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in names]
    goal = dict(zip(names, mixing.targets(sums, [1 + i % 3 for i in range(len(names))]), strict=True))
    source = {r[0]: r[3] for r in rows}
    taken, found = Counter(), got(out)
    assert Counter((x[0], x[1]) for x in found) == Counter((r[0], size[i]) for i, r in enumerate(rows))
    for doc, n, whole, target, take in found:
        s = source[doc]
        assert whole == sums[names.index(s)] and np.isclose(target, goal[s]) and 0 <= take <= 3 * n
        taken[s] += take
    assert all(taken[s] == round(goal[s]) for s in names)
    assert mixing.mix_report(spark, none, block).count() == 0
    if block == 64:  # repeated rows, null ids and rows of one id with different texts among them
        given = rows + [(None if i % 2 else 7, f"{r[1] or ''} x{i % 5}", *r[2:]) for i, r in enumerate(rows[20:60])]
        given = spark.createDataFrame(given, SCHEMA).repartition(3)
        report = Counter()
        for r in mixing.mix_report(spark, given, block, shard_slots=8).collect():
            report[r.doc_id] += r.taken
        mixed, words = mixing.mixed_documents(spark, given, block, shard_slots=8), Counter()
        texts = defaultdict(Counter)
        for r in given.collect():
            texts[r.doc_id] += Counter(SPACE.findall(r.text or ""))
        assert mixed.columns == given.columns
        for r in mixed.collect():
            words[r.doc_id] += len(SPACE.findall(r.text))
            assert r.n_chars == len(r.text) and set(SPACE.findall(r.text)) <= set(texts[r.doc_id])
        assert {k: v for k, v in report.items() if v} == dict(words)


def test_shards_take_all_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    sources = [{"id": i, "words": w, "size": w, "blocks": -(-w // 4), "rounds": 1, "rest": 0} for i, w in enumerate((400, 37, 0, 1200))]
    rows = mixing.draw(spark, sources, 4, 10, 1).collect()
    for p in sources:
        own = sorted((r["first"], r["n"]) for r in rows if r["id"] == p["id"])
        at = 0
        for first, n in own:
            assert first == at
            at += n
        assert at == p["blocks"]
    dealt = Counter()
    for r in rows:
        dealt[r.shard] += r.n
    assert sum(dealt.values()) == 410 and all(n <= 10 for n in dealt.values()) and sum(n < 10 for n in dealt.values()) <= 1 + 410 // 30


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_pii_base(spark, docs, rows, none):
    rng = random.Random(3)
    for _ in range(20000):
        t = "".join(rng.choice("a@.1 -+()9b0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t
    for r in pii.find_pii(spark, docs).collect():
        base = brute_spans({x[0]: x[1] for x in rows}[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))
    assert pii.find_pii(spark, none).count() == 0
    masked = pii.mask_pii(spark, docs)
    assert masked.columns == docs.columns and not any("@mail" in (r.text or "") for r in masked.collect())


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("john [at] mail (dot) example [dot] com ok", "email", "john [at] mail (dot) example [dot] com"),
        ("to john dot smith at mail dot example dot com today", "email", "john dot smith at mail dot example dot com"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("jo​hn@exam​ple.com.", "email", "jo​hn@exam​ple.com"),
        ("ｊohn＠example．com", "email", "ｊohn＠example．com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("ip one nine two dot one six eight dot one dot one x", "ip", "one nine two dot one six eight dot one dot one"),
        ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, every = pii.all_spans(text)
    assert (base, [(text[s:e], k) for s, e, k in every]) == ([], [(found, kind)])
    assert pii.mask(text, every) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to jane [at] example dot com now", "jane [at] example dot com"),
        ("to jane at example [dot] com now", "jane at example [dot] com"),
        ("to jane@example dot com now", "jane@example dot com"),
        ("to jane dot roe (at) mail dot example [dot] com.", "jane dot roe (at) mail dot example [dot] com"),
        ("to jane at mail.example dot com.", "jane at mail.example dot com"),
        ("to jane at example\u3002com now", "jane at example\u3002com"),
        ("to jane\ufe6bexample\ufe52com now", "jane\ufe6bexample\ufe52com"),
    ],
)
def test_pii_mixed_disguises(text, found):
    assert [(text[s:e], k) for s, e, k in pii.all_spans(text)[1]] == [(found, "email")]


@pytest.mark.parametrize("text", ["look at example.com now", "look at 3.5 dot", "@ dot com", "a@ dot com", "me@home dot 5", "see [at] dot com"])
def test_pii_leaves_plain_dots_alone(text):
    assert pii.all_spans(text) == ([], [])


def test_pii_hints_hold_all_that_folds():
    lost = [c for c in map(chr, range(0x110000)) if pii.fold(c) != c and not pii._HINT_CHARS.search(c)]
    assert not lost
    for zero in "\u09e6\u0e50\u2070":  # Bengali, Thai, superscript
        text = f"card {zero.join('4111')} x {''.join(chr(ord('\u09e6') + int(d)) if zero != '\u0e50' else chr(0xe50 + int(d)) for d in '4111111111111111')} end"
        assert [k for _, _, k in pii.all_spans(text)[1]] == ["card"], text


@pytest.mark.parametrize("text", ["meet at noon the dot is", "one two three trees at the dot", "", "at dot", "look at that. dot", "five six seven", "(at) (dot)"])
def test_pii_leaves_prose_alone(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["plus " + "one " * 10 + "one", "call plus " + "five " * 10 + "five now", "plus neun " + "neun-" * 10 + "neun"])
def test_pii_one_digit_word_alone(text):
    assert [k for _, _, k in pii.all_spans(text)[1]] == ["phone"]


def test_added_spans_equal_all_against_all():
    rng = random.Random(12)
    parts = ["a@b.cc ", "ａ@b.cc ", "x (at) y dot com ", "+1 555 010 2030 44 ", "+１ 555 010 2030 44 ", "10.0.0.1 ", "10.0.0.١ ", "@", "4111 1111 1111 1111", " 4１11 1111 1111 1111 ", "one two three four "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        base, every = pii.all_spans(text)
        r, added = pii.rewrite(text), []
        for start, end, kind in pii.base_spans(r.text) if r else ():
            if r.touched(start, end):
                s, e = r.source(start, end)
                if not any(k == kind and a < e and s < b for a, b, k in (*base, *added)):
                    added.append((s, e, kind))
        assert Counter(every) == Counter([*base, *added]), text


def test_pii_is_linear():
    for n in (1000, 16000):  # many added spans among many base spans
        at = time.process_time()
        assert len(pii.all_spans("a@b.cc ａ@b.cc x (at) y dot com " * n)[1]) == 3 * n
        took = time.process_time() - at
        first = took if n == 1000 else first
    assert took < 40 * max(first, 0.05)
    for t in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000, "one " * 50_000, "at dot " * 40_000, "0" * 6000 + ".1.1.1"):
        pii.all_spans(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(rows, name):
    texts = [r[1] or "" for r in rows] + ["it's I'LL <|endoftext|>", "İstanbul ǅ x", "á b\x1c\x85 c\xa0d", "ª² µ ß½ ×", "  two  spaces "]
    enc = tokens.Encoder(P.path(name))
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, rows, none, tmp_path):
    path = P.path("word_bpe_49k.json")
    library, start, want = tokens.encoder(path).library, 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got(token_files.token_report(spark, docs, path)) == sorted(want, key=repr)
    assert token_files.token_report(spark, none, path).count() == 0
    uri = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs, uri, path, frame_bytes=2000).collect()
    some = token_files.read_documents(uri, manifest[0].file, {1, 7})
    for d, ids in some.items():
        assert ids.tolist() == [*library.encode(rows[d][1] or "", add_special_tokens=False).ids, 1]
    file = tmp_path / "files" / manifest[0].file
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(file.read_bytes(), read_across_frames=True).read()) >= 4 * manifest[0].n_ids
    raw = bytearray(file.read_bytes())
    raw[20] ^= 1
    file.write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)), file.open("rb") as f:
        list(token_files.Reader(f).documents())


def test_warc(spark, tmp_path):
    rng = random.Random(5)
    long = "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"
    texts = ["a" * 99, "a" * 99, "b" * 100, "b" * 100, "é" * 50, "é" * 50, None, "", long, long, "tail\r\n\r\n", "".join(rng.choice("ab\r\n") for _ in range(5000))]
    pages = [(100 - i, f"http://h/{i} \n" if i % 3 else None, t, "extra") for i, t in enumerate(texts)] + [(91, "u", long, "extra")]
    given = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    first = {}
    for p, _, t, _ in pages:
        first[t or ""] = min(p, first.get(t or "", 10**9))
    want = []
    for p, _, t, _ in pages:
        raw = (t or "").encode()
        revisit = len(raw) >= 100 and first[t or ""] != p
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[t or ""] if revisit else None))
    out = warc.archive_report(spark, given)
    assert got(out.drop("digest_ok")) == sorted(want, key=repr) and out.where("not digest_ok").isEmpty()
    assert warc.archive_report(spark, given.limit(0)).count() == 0
    with common.Workspace(spark, "t") as ws:
        manifest = ws.stage(warc.write_archives(warc.with_references(ws, given), f"{ws.uri}/files"))
        chunks = warc.read_archives(manifest, f"{ws.uri}/files", chunk_bytes=1000).collect()
    whole = defaultdict(dict)
    for c in chunks:
        assert len(c.data) <= 1000
        if c.record_type == "response":
            whole[c.page_id][c.chunk_offset] = bytes(c.data)
    for p, n, digest, kind, _ in want:
        if kind == "response":
            joined = b"".join(whole[p][k] for k in sorted(whole[p]))
            assert len(joined) == n and hashlib.sha256(joined).hexdigest() == digest


def brute_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        left = bytes(np.frombuffer(t, np.uint8)[~hit])
        out.append((r[0], len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, docs, rows, none):
    assert got(repeats.repeats_report(spark, docs)) == brute_repeats(rows, 400)
    assert repeats.repeats_report(spark, none).count() == 0
    assert repeats.remove_repeats(spark, docs).columns == docs.columns


@pytest.mark.parametrize("length", [10, 24])
def test_repeats_of_dense_text(spark, length, monkeypatch):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("ab") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, "abc" * 40), (101, "a" * 97), (102, rows[3][1]), (103, "".join(rng.choice("ab") for _ in range(3000)))]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.repeats_report(spark, given, length)) == brute_repeats(rows, length)


def test_repeats_across_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    lo, n, _, _ = repeats.regions(text)
    assert n.sum() == len(text) - 399 and (np.diff(lo) == n[:-1]).all() and n.max() <= 201


@pytest.mark.parametrize("length", [3, 8, 20])
def test_merged_transforms(length):
    rng = random.Random(length)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) for _ in range(4)] for _ in range(3)]
    shards[1][0] = shards[0][1]
    texts = [t for s in shards for t in s]
    want = brute_repeats([(i, t.decode()) for i, t in enumerate(texts)], length)
    found = bwt_merge.repeated(shards, length)
    out = []
    for i, t in enumerate(texts):
        spans = repeats.united([(a, a + length) for a in found[i]])
        left = repeats.without(t, spans)
        out.append((i, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    assert sorted(out, key=repr) == want


@pytest.mark.parametrize(("seed", "letters", "depth"), [(1, b"a", 6), (2, b"ab", 4), (3, b"ab\0\xff", 30), (4, b"abcdefgh", 12)])
def test_merges_equal_sorted_suffixes(seed, letters, depth):
    """Order, symbols and common prefixes of merges of merges, of copies and of empty texts and shards."""
    rng = random.Random(seed)
    make = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(0, 40)))
    shared = make() + make()
    shards = [[rng.choice([make(), shared, shared[5:] + make(), b""]) for _ in range(k)] for k in (3, 0, 5, 1)]
    texts = [t for s in shards for t in s]
    built, first = [], 0
    for s in shards:
        built.append(bwt_merge.build(s, first))
        first += len(s)
    left, right = bwt_merge.merge(built[0], built[1], depth), bwt_merge.merge(built[2], built[3], depth)
    suffixes = sorted(([*(c + 1 for c in t[k:]), i - len(texts)], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
    common = [0] + [next(k for k, (x, y) in enumerate(zip(p[0], q[0], strict=False)) if x != y) for p, q in zip(suffixes, suffixes[1:], strict=False)]
    for got in (bwt_merge.merge(left, right, depth), bwt_merge.merge(bwt_merge.merge(left, built[2], depth), built[3], depth)):
        places = list(zip(got.text.tolist(), got.place.tolist(), strict=True))
        start = lambda i, k: ([*(c + 1 for c in texts[i][k:]), i - len(texts)])[: depth + 1]
        assert sorted(places) == sorted(x[1:] for x in suffixes) and [start(*x) for x in places] == [x[0][: depth + 1] for x in suffixes]
        assert got.symbol.tolist() == [texts[i][k - 1] + 1 if k else 0 for i, k in places]
        assert got.common.tolist() == [min(c, depth + 1) for c in common]
