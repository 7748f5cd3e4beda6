"""The corpus pipeline, stage by stage, against brute-force versions of each."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from factloom.llm import mixing, pii, tokens  # noqa: E402
from tests.llm.test_operators import SPACE, brute_near, brute_rules, corpus  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows = [r[:5] for r in corpus(seed=3, n=60)]
    rows += [(None if i % 3 else 4, f"{r[1]} {r[1]}"[:1500], r[2], r[3], r[4]) for i, r in enumerate(rows[20:50])]  # null and repeated ids
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The documents, then what each stage makes of its predecessor's, as lists of rows."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), tmp_path_factory.mktemp("stages")
    out = [list(map(tuple, docs.collect()))]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(list(map(tuple, docs.collect())))
        assert i == 4 or docs.schema.simpleString() == spark.read.parquet(f"{sf_dir}/documents.parquet").schema.simpleString()
    return out


def test_stages_in_order(tables):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "pii", "mixing", "packing"]
    assert all(tables)


def test_rules_keep_what_brute_force_keeps(tables):
    numbered = [(i, *r[1:]) for i, r in enumerate(tables[0])]
    kept = [tables[0][x[0]] for x in brute_rules(numbered, 50) if x[-1]]
    assert Counter(tables[1]) == Counter(kept) and len(kept) < len(tables[0])


def test_one_row_of_each_group_of_near_copies_stays(tables):
    groups = defaultdict(list)
    for i, _, least, _ in brute_near([(i, r[1]) for i, r in enumerate(tables[1])], 5):
        groups[least].append(tables[1][i])
    assert len(tables[2]) == len(groups) < len(tables[1])
    left = Counter(tables[2])
    for rows in groups.values():
        ids = [r[0] for r in rows if r[0] is not None]
        found = [r for r in rows if left[r] and r[0] == min(ids, default=None)]
        assert found
        left[found[0]] -= 1


def test_personal_data_is_masked(tables):
    want = []
    for doc_id, text, lang, source, _ in tables[2]:
        masked = pii.mask(text, pii.all_spans(text)[1])
        want.append((doc_id, masked, lang, source, len(masked)))
        assert not pii.base_spans(masked)
    assert Counter(tables[3]) == Counter(want)


def test_the_mix_meets_the_targets(tables):
    size, taken, by_id = Counter(), Counter(), defaultdict(Counter)
    for doc_id, text, _, source, _ in tables[3]:
        size[source] += len(SPACE.findall(text))
        by_id[doc_id, source] += Counter(SPACE.findall(text))
    for doc_id, text, _, source, n_chars in tables[4]:
        words = Counter(SPACE.findall(text))
        taken[source] += words.total()
        assert n_chars == len(text) and all(n <= by_id[doc_id, source][w] for w, n in words.items())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))])
    assert [taken[s] for s in names] == [round(x) for x in goal]


def test_pieces_hold_all_tokens(tables):
    library, want = tokens.encoder(P.path("byte_bpe_50k.json")).library, Counter()
    for doc_id, text, *_ in tables[4]:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += Counter((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter(r[:5] for r in tables[5]) == want
    bins = defaultdict(list)
    for r in tables[5]:
        bins[r[5]].append((r[6], r[3]))
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())


def test_run_chains_the_stages(spark, sf_dir, tables):
    assert Counter(r[:5] for r in map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(r[:5] for r in tables[5])
