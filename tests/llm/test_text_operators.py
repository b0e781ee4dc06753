"""Packing, mixing and splitting against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.llm import queries, sizes
from tidegraph.llm.mixing import SourceClassifier, _whole, bucket_counts, fit_classifier, mix
from tidegraph.llm.packing import first_fit_decreasing, pack
from tidegraph.llm.sizes import sizer, text_size, text_sizes
from tidegraph.llm.splitting import BOUNDARIES, Splitter, bisect, cut_paragraphs, split_documents, units_of

TOKENIZERS = "/opt/tokenizers"
texts = st.text(alphabet=st.sampled_from(list("ab1 .\n\r\t,é漢字!?— ١")), max_size=120)


def brute_size(t: str) -> int:
    return len(regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", t))


# --- sizes -------------------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), texts), max_size=8))
def test_sizes(values):
    assert text_sizes(values).tolist() == [0 if v is None else brute_size(v) for v in values]


def test_sizes_over_windows(monkeypatch):
    monkeypatch.setattr(sizes, "WINDOW", 50)
    values = ["word " * 40, "x" * 333, "", None, "a.b " * 3, "é" * 49 + "é"]
    assert text_sizes(values).tolist() == [0 if v is None else brute_size(v) for v in values]


def test_size_column(spark):
    df = spark.createDataFrame([(1, "Hi, you"), (2, None), (3, ""), (4, "  \n")], "i int, size string")
    assert [r.n for r in df.select("i", text_size("size").alias("n")).orderBy("i").collect()] == [3, 0, 0, 0]
    assert df.limit(0).select(text_size("size")).count() == 0


@pytest.mark.parametrize("kind,file", [("tokenizers", "byte_bpe_50k.json"), ("tiktoken", "byte_bpe_50k.tiktoken"), ("sentencepiece", "piece_bpe_32k.model")])
def test_public_tokenizers(kind, file):
    path = os.path.join(TOKENIZERS, file)
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    got = sizer((kind, path))(["hello world", None, "", "naïve 漢字 <|endoftext|>"])
    assert got[0] >= 2 and got[1] == got[2] == 0 and got[3] > 3


# --- packing -----------------------------------------------------------------------------------------


def plain_ffd(items, capacity):
    free, out = [], []
    for s in items:
        for b, room in enumerate(free):
            if room >= s:
                break
        else:
            b = len(free)
            free.append(capacity)
        free[b] -= s
        out.append(b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_decreasing(values):
    values = sorted(values, reverse=True)
    assert first_fit_decreasing(np.array(values, int), 50).tolist() == plain_ffd(values, 50)


def test_pack_keeps_everything(spark):
    rng = np.random.default_rng(4)
    items = [(i, int(s)) for i, s in enumerate(rng.pareto(1.1, 1_500) * 60)] + [(5_000, None), (5_001, 0), (5_002, 100), (5_002, 100), (5_003, 1_000), (5_004, -3), (None, 7)]
    df = spark.createDataFrame(items, "part_no bigint, group_no bigint")
    got = pack(df.toDF("doc", "container_id"), "doc", "container_id", capacity=100, group_items=300)
    frame = got.toPandas()
    assert frame.groupby("container_id").part_size.sum().max() <= 100
    want = pd.Series([max(s or 0, 0) for _, s in items]).sum()
    assert frame.part_size.sum() == want and len(frame[frame.doc.isna()]) == 1
    for i, s in items[:1_500]:
        mine = frame[frame.doc == i].sort_values("part_no")
        assert mine.part_size.sum() == s and (s > 100) == (len(mine) > 1)
        assert mine.part_start.tolist() == [100 * k for k in range(len(mine))] and (mine.part_size[:-1] == 100).all()
    assert len(frame[frame.doc == 5_002]) == 2
    containers = frame.container_id.nunique()
    assert want / (containers * 100) > 0.97
    assert pack(df.limit(0).toDF("doc", "size"), "doc", "size").count() == 0
    with pytest.raises(ValueError):
        pack(df, "part_no", "group_no", capacity=0)


# --- mixing ------------------------------------------------------------------------------------------


def vocabulary_text(rng, source: int, words: int) -> str:
    return " ".join(f"w{source}x{rng.integers(40)}" if rng.random() < 0.5 else f"common{rng.integers(80)}" for _ in range(words))


def test_bucket_counts():
    a, b, c = bucket_counts(["one two two, ONE", "", "two one"])
    assert a[1].sum() == 5 and len(b[0]) == 0 and c[1].sum() == 2
    assert set(c[0]) <= set(a[0])
    assert sorted(bucket_counts(["x" * 10])[0][0]) == sorted(bucket_counts(["pad", "x" * 10])[1][0])


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(12)
    rows = [(i, vocabulary_text(rng, i % 4, 30), i % 4) for i in range(480)]
    train = spark.createDataFrame(rows[:400], "doc_id bigint, text string, source_no int")
    model = fit_classifier(train, ["a", "b", "c", "d"], per_source=50)
    held = rows[400:]
    guess = model.posteriors([t for _, t, _ in held]).argmax(1)
    assert (guess == [s for *_, s in held]).mean() > 0.95
    assert np.allclose(SourceClassifier(["a", "b"]).fit([]).posteriors(["x"]), 0.5)


def test_classifier_is_fitted_on_all_labelled_documents(spark):
    """A word that only documents beyond any bound of a sample have is learnt; a source without documents stays finite."""
    rng = np.random.default_rng(7)
    rows = [(i, vocabulary_text(rng, i % 2, 12) + (" rare" if i % 2 and i >= 700 else ""), i % 2) for i in range(900)]
    # The two kinds of documents look alike but for the word.
    rows = [(i, t.replace("w0x", "wx").replace("w1x", "wx"), s) for i, t, s in rows]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "wx1", None)], "doc_id bigint, text string, source_no int")
    model = fit_classifier(docs, ["a", "b", "none"])
    with_word, without = model.posteriors(["wx1 common2 rare", "wx1 common2"])
    assert with_word[1] > 0.7 > without[1] and 0 < with_word[2] < 0.05
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias).all()
    seen = []
    plain = SourceClassifier.fit
    try:
        SourceClassifier.fit = lambda self, rows: (seen.append(rows.count()), plain(self, rows))[1]
        mix(docs.select("doc_id", "text", F.lit(10).alias("size"), F.when(F.col("source_no") == 0, "a").when(F.col("source_no") == 1, "b").alias("source")), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int"), steps=2)
    finally:
        SourceClassifier.fit = plain
    assert seen == [901]
    one = fit_classifier(docs.filter("source_no = 0"), ["a", "b"])
    assert one.posteriors(["x"])[0, 0] > 0.99 and np.allclose(fit_classifier(docs.limit(0), ["a", "b"]).posteriors(["x"]), 0.5)


def test_whole_copies():
    rng = np.random.default_rng(3)
    n = 4_000
    label, size, cap = rng.integers(-1, 3, n), rng.integers(1, 900, n), np.where(rng.random(n) < 0.5, 1.0, 3.0)
    rate = np.minimum(rng.random(n) * 3, cap)
    carried, copies = {}, []
    for part in np.array_split(np.arange(n), 7):
        copies.append(_whole(rate[part], label[part], size[part], cap[part], carried))
    copies = np.concatenate(copies)
    assert (np.abs(copies - rate) < 1).all() and (copies <= cap).all()
    for s in range(-1, 3):
        at = label == s
        assert abs((copies * size)[at].sum() - (rate * size)[at].sum()) <= 900


def mixture_input(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for s, n in (("a", 300), ("b", 150), ("c", 20)):
        for _ in range(n):
            rows.append((i, vocabulary_text(rng, "abc".index(s), 25), s, 25))
            i += 1
    rows += [(i + k, vocabulary_text(rng, 0, 25), None, 25) for k in range(10)] + [(900, None, "a", 0), (901, "", "zzz", 0), (901, "", "zzz", 0), (902, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size bigint").withColumn("member", F.lit(1))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("weight", [1.0, 0.9, 0.7])
def test_mix(spark, weight):
    docs, targets = mixture_input(spark)
    m = mix(docs, targets, label_weight=weight, per_source=40)
    report = {r.source: r for r in m.report.collect()}
    total = 470 * 25
    assert report["a"].mixture_size == total
    # c cannot reach its share: it is used as often as allowed. a and b reach theirs.
    assert report["c"].labelled_used_size == 20 * 25 * 2 and report["c"].mean_rate == 2 and report["c"].expected_size < 0.2 * total
    for s in "ab":
        assert report[s].expected_size == pytest.approx(0.4 * total, rel=0.002)
        assert report[s].used_size == pytest.approx(0.4 * total, rel=0.02) and report[s].reached == pytest.approx(1, abs=0.02)
    documents = m.documents.collect()
    assert len(documents) == docs.count()
    cap = {"a": 1, "b": 2, "c": 2, None: 1}
    assert all(0 <= d.copies <= cap[d.source] and 0 <= d.rate <= cap[d.source] for d in documents)
    # The report's fitted size is the sum over all documents by membership.
    for i, s in enumerate("abc"):
        assert report[s].expected_size == pytest.approx(sum(d.rate * d.size * d.member[i] for d in documents), rel=1e-4, abs=0.01)
    assert m.residuals[-1] < m.residuals[0]
    assert sum(r.actual_share for r in report.values() if r.actual_share) == pytest.approx(1)


def test_every_document_is_placed_by_the_classifier(spark):
    docs, targets = mixture_input(spark)
    m = mix(docs, targets, per_source=40)
    # All ten texts without a source look like a: a's labelled documents are needed that much less.
    documents = m.documents.filter("size > 0").collect()
    assert all(d.member[0] > 0.9 for d in documents if d.source is None)
    assert all(d.member["abc".index(d.source)] > 0.9 for d in documents if d.source)
    none, labelled = (sum(d.rate * 25 for d in documents if d.source == s) for s in (None, "a"))
    assert none > 0 and labelled + none == pytest.approx(0.4 * 470 * 25, rel=0.05)
    # Labels lie on a third of b's texts, which read like a: soft memberships move them there in part.
    wrong = docs.withColumn("source", F.when((F.col("source") == "a") & (F.col("doc_id") % 3 == 0), "b").otherwise(F.col("source")))
    soft = {d.doc_id: d.member for d in mix(wrong, targets, label_weight=0.5, per_source=60).documents.filter("size > 0").collect()}
    assert np.mean([soft[i][0] for i in range(0, 300, 3)]) > 0.25 and np.mean([soft[i][0] for i in range(300, 450)]) < 0.1


def test_found_sources_come_from_fit_and_classifier(spark, monkeypatch, tmp_path):
    """With no step, or with a classifier that was not trained, the fit finds other sources short."""
    docs, _ = mixture_input(spark)
    docs.drop("size", "member").withColumn("case_id", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    targets = [("a", 0.55, 1), ("b", 0.25, 2), ("c", 0.05, 1), ("d", 0.15, 2)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "source_targets.parquet"))
    found = lambda: sorted(r.source for r in queries.p9_found(spark, str(tmp_path)).collect())
    assert found() == ["c", "d"]
    plain = queries.mix
    monkeypatch.setattr(queries, "mix", lambda *a: plain(*a, steps=0))
    assert found() == ["d"]  # no documents at all: at its cap whatever the fit does
    monkeypatch.setattr(queries, "mix", plain)

    def untrained(self, _):
        self.weights, self.bias = np.zeros((len(self.sources), 1 << 12), np.float32), np.zeros(len(self.sources), np.float32)
        return self

    monkeypatch.setattr(SourceClassifier, "fit", untrained)
    assert found() != ["c", "d"]


def test_mix_edges(spark):
    docs, targets = mixture_input(spark)
    empty = mix(docs.limit(0), targets)
    assert empty.documents.count() == 0 and empty.report.count() == 4
    with pytest.raises(ValueError):
        mix(docs, targets.unionByName(targets))
    with pytest.raises(ValueError):
        mix(docs, targets.limit(0))
    with pytest.raises(ValueError):
        mix(docs, targets, label_weight=1.5)


def test_many_targets(spark):
    docs, _ = mixture_input(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)] + [(f"s{i}", 0.0, 1) for i in range(1_200)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mix(docs, targets, per_source=20, steps=6).report.filter("documents > 0").collect()}
    assert set(report) == {"a", "b", None}


# --- splitting ---------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=6).map("".join), st.integers(1, 30), st.integers(0, 29))
def test_round_trip_and_limits(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    s = Splitter(limit, overlap)
    pieces = s.pieces(text)
    assert "".join(text[core:end] for _, core, end, *_ in pieces) == text
    for i, (start, core, end, size, *_) in enumerate(pieces):
        assert brute_size(text[start:end]) == size and (size <= limit or len(pieces) == 1 == limit)
        if i:
            assert brute_size(text[start:core]) == min(overlap, pieces[i - 1][3])
            assert pieces[i - 1][0] <= start and core == pieces[i - 1][2]
    if brute_size(text) <= limit:
        assert len(pieces) == 1


def test_boundaries_are_preferred():
    sentence = "one two three four. "
    text = (sentence * 6).strip() + "\n\n" + (sentence * 5).strip() + "\n" + (sentence * 3).strip()
    pieces = Splitter(40, 5).pieces(text)
    assert [p[4] for p in pieces] == ["start", "paragraph"] or "paragraph" in [p[4] for p in pieces]
    assert text[pieces[1][1] :].startswith("one two")
    assert all(p[4] in (*BOUNDARIES, "start") for p in pieces)
    assert [p[4] for p in Splitter(10, 0).pieces(sentence * 4)][1:] == ["sentence"] * 3 or all(b in ("sentence", "word") for b in [p[4] for p in Splitter(10, 0).pieces(sentence * 4)][1:])
    assert bisect(np.zeros(5, np.int8), 5, 0) == []


@given(texts)
def test_unit_strengths(text):
    u = units_of(text)
    assert len(u.starts) == brute_size(text)
    for a, b, s in zip(u.starts, u.starts[1:], u.strength[1:], strict=False):
        between = text[a:b]
        tail = between[len(between.rstrip()) :]
        ends = len(regex.findall(r"\r\n|\n|\r", tail))
        assert (s == 4) == (ends >= 2) and (s == 3) == (ends == 1)


def test_units_over_windows(monkeypatch):
    import tidegraph.llm.splitting as sp

    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("ab .\n\r,")) for _ in range(2_000)) + "z" * 300 + " end."
    whole = units_of(text)
    monkeypatch.setattr(sp, "WINDOW", 64)
    parts = units_of(text)
    assert parts.starts.tolist() == whole.starts.tolist() and parts.strength.tolist() == whole.strength.tolist()


def brute_paragraphs(text):
    out, held = [], []
    for line in [*regex.split(r"\r\n|\n|\r", text), ""]:
        if line.strip():
            held.append(line)
        elif held:
            out.append(sum(map(brute_size, held)))
            held = []
    return out


@settings(deadline=None)
@given(st.lists(texts, max_size=6).map("\n\n".join), st.integers(2, 20))
def test_large_paragraphs_are_cut(text, limit):
    cut = {p: n for *_, boundary, p, n in Splitter(limit, 1).pieces(text) if boundary not in ("start", "paragraph")}
    sizes_ = brute_paragraphs(text)
    assert {i + 1 for i, n in enumerate(sizes_) if n > limit} <= set(cut)
    assert all(sizes_[p - 1] == n for p, n in cut.items())


def test_split_columns(spark):
    rows = [(1, "a b c. " * 300), (1, "short"), (2, None), (3, ""), (4, " \n"), (None, "x"), (5, "é" * 3)]
    df = spark.createDataFrame(rows, "piece_no int, size string").toDF("doc", "text")
    got = split_documents(df, "doc", "text").toPandas()
    assert sorted(got.groupby("doc", dropna=False).size().tolist()) == [1, 1, 1, 1, 1 + (got.doc == 1).sum() - 1]
    assert got["size"].max() <= 400 and (got[got.doc == 3]["size"] == 0).all()
    long = got[(got.doc == 1) & (got.piece != "short")].sort_values("piece_no")
    assert "".join(p[c - s :] for p, c, s in zip(long.piece, long.core_start, long.start, strict=True)) == rows[0][1]
    assert cut_paragraphs(split_documents(df, "doc", "text"), "doc").collect() == [(1, 1, 1_200)]
    assert split_documents(df.limit(0), "doc", "text").count() == 0 and cut_paragraphs(split_documents(df.limit(0), "doc", "text"), "doc").count() == 0
    with pytest.raises(ValueError):
        Splitter(10, 10)


def test_classes_cover_unicode():
    table = sizes.character_classes()
    for c in ("a", "١", "漢", "Ⅷ", "½"):
        assert table[ord(c)] == sizes.WORD and unicodedata.category(c)[0] in "LN"
    for c in (" ", "\xa0", "\x85", "\n"):
        assert table[ord(c)] == sizes.SPACE


def test_units_after_more_leading_whitespace_than_a_window(monkeypatch):
    import tidegraph.llm.splitting as sp

    text = " " * 300 + "One two three. Four five six seven eight nine ten eleven twelve.\n\nThirteen " * 6
    whole = units_of(text)
    monkeypatch.setattr(sp, "WINDOW", 64)
    parts = units_of(text)
    assert parts.starts.tolist() == whole.starts.tolist() and parts.strength.tolist() == whole.strength.tolist()
