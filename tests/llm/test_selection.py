"""Quality rules, toxicity, URL filters and source mixing."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from railpulse.llm import mixing, quality_rules, toxicity, url_filter
from tests.llm import plain

SF = "/root/testdata/sf0.1"


# --- quality rules

def features(text):
    words = plain.words(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if plain.words(x)]
    return (len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text or ""),
            len(lines) - len(set(lines)), len(repeated))


def test_base_features_equal_plain_counting(frame, sentence):
    part = sentence(20)
    rows = [(1, sentence(80)), (2, part + "\n" + part + "\n" + part), (3, "# a # b $\n# a # b $"), (4, None), (5, ""),
            (6, "a " * 60), (7, sentence(49)), (8, sentence(50)), (9, "\u00a0" + sentence(60) + "\x0b\x1c x")]
    got = {r.doc_id: r for r in quality_rules.judge(frame(rows)).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        want = features(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_an_outlier_of_its_group_goes_and_clean_texts_stay(frame, sentence):
    rows = [(i, sentence(100), "en", "web") for i in range(300)]
    rows.append((900, sentence(100).replace(" ", " # $ % "), "en", "web"))
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(rows)).collect()}
    assert not got[900] and sum(got.values()) >= 285


# --- toxicity

def test_held_out_texts_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels)
    rows = got.join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    assert got.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    asked = [r for r in rows if r.held_out]
    flagged = [r for r in asked if r.predicted]
    toxic = [r.score for r in asked if r.toxic]
    clean = [r.score for r in asked if not r.toxic]
    assert sum(r.toxic for r in flagged) >= 0.75 * len(flagged) and flagged
    in_order = sum((x > y) + (x == y) / 2 for x in toxic for y in clean)
    assert in_order >= 0.8 * len(toxic) * len(clean)


def test_scores_are_those_of_a_plain_network():
    """Sums of word vectors, windows of every width, maxima and the output, one text and one window at a time."""
    random = np.random.default_rng(5)
    model = toxicity.ToxicityModel(
        words=random.normal(0, 1, (toxicity.HASHED_WORDS + 1, toxicity.DIMENSIONS)).astype(np.float32),
        filters=[random.normal(0, 1, (w, toxicity.DIMENSIONS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        biases=[random.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS],
        out=random.normal(0, 0.1, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), out_bias=0.3,
    )
    model.words[toxicity.HASHED_WORDS] = 0
    ids = toxicity.WordIds()
    texts = [ids.of(t) for t in ("", "one", "two words", "three short words", "a b c d e f g " * 30, None, "the end")]
    for text, score in zip(texts, model.score(texts)):
        vectors = [model.words[list(units)].sum(axis=0) for units in text] + [np.zeros(toxicity.DIMENSIONS)] * toxicity.PAD
        features = []
        for filters, bias in zip(model.filters, model.biases):
            windows = [sum(vectors[at + j] @ filters[j] for j in range(len(filters))) for at in range(len(text))]
            best = np.max(windows, axis=0) if windows else np.zeros(toxicity.FILTERS)
            features.append(np.maximum(best + bias, 0))
        plain_score = 1 / (1 + np.exp(-(np.concatenate(features) @ model.out + model.out_bias)))
        assert score == pytest.approx(plain_score, abs=1e-4)


def test_thresholds_are_calibrated_by_language(spark, frame, sentence):
    rows = [(i, sentence(15) + (" vileword" if i % 2 else ""), ("en", "de", "fr")[i % 3], "web") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(900) if i % 3 < 2 or i < 9], "doc_id long, toxic int")
    model = toxicity.train(frame(rows), labels)
    assert set(model.thresholds) == {"en", "de"} and model.threshold("fr") == toxicity.THRESHOLD == model.threshold(None)
    got = toxicity.toxicity_scores(frame(rows), labels).collect()
    assert all(r.threshold == model.threshold(rows[r.doc_id][2]) for r in got)
    assert all(r.rejected == (r.score >= r.threshold) and r.predicted == int(r.score >= 0.3) for r in got)
    kept = {r.doc_id for r in toxicity.without_toxic(frame(rows), labels).collect()}
    assert kept == {r.doc_id for r in got if not r.rejected}


def test_training_takes_all_labelled_rows(spark, frame):
    """Toxic texts and a language that only rows beyond the first 6000 by hash have."""
    seen = spark.range(9000).where("crc32(cast(id AS string)) % 4 != 2").orderBy(F.xxhash64("id"), "id")
    late = {r.id for r in seen.collect()[6000:]}
    toxic = {i for i in late if i % 2}
    rows = [(i, "a vileword here" if i in toxic else "a good word here", "de" if i in late else "en", "web") for i in range(9000)]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(9000)], "doc_id long, toxic int")
    model = toxicity.train(frame(rows), labels)
    ids = toxicity.WordIds()
    bad, good = model.score([ids.of("a vileword here"), ids.of("a good word here")])
    assert bad > 0.5 > 0.1 > good and set(model.thresholds) == {"de"} and good < model.threshold("de") < bad
    total = sum(i % 4 != 2 for i in map(lambda i: zlib.crc32(str(i).encode()), range(9000)))
    assert model.prior == pytest.approx(len(toxic) / total, abs=0.01)


def test_only_toxic_texts_go(spark, frame, sentence):
    rows = [(i, sentence(20) + (" vileword" if i % 3 == 0 else "") + " " + sentence(20)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    left = toxicity.without_toxic(frame(rows), labels)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == frame(rows).columns
    assert len([i for i in kept if i % 3 == 0]) <= 6 and len([i for i in kept if i % 3]) >= 394


# --- URL filters

RULED = [
    ("http://example.org/en/1x", "example.org", "/en/1x", "example.org/en/1", "block"),
    ("http://a.EXAMPLE.org/es/?q", "a.example.org", "/es/", "example.org/es/", "block"),
    ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("ftp://x.com/de/1#f", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/fr/http://y.com/de/", "x.com", "/fr/http://y.com/de/", "com/fr/", "allow"),
    ("x://org", "org", "", None, None), (None, "", "", None, None), ("example.org/es/", "", "", None, None),
    ("http://x.com?a/de/", "x.com", "", None, None), ("://\n.org/a\nb", "\n.org", "/a\nb", "org/", "allow"),
]


def test_rules_on_host_and_path(spark):
    pages = spark.createDataFrame(
        [(i, u[0], "x", "y") for i, u in enumerate(RULED)], "page_id long, url string, host string, grams string"
    )
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def plain_rule(url):
    """(host, path, rule, verdict) in plain Python."""
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
    fits = [r for r in url_filter.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (host, path, best.text, best.verdict) if best else (host, path, None, None)


def test_all_pages_are_judged_as_by_plain_code(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(10**6 + i, u) for i, u in enumerate(["HTTP://a.b.ORG/ES/", "http://x.org/" + "p/" * 3000, "http://org/", "http://:80/es/", "",
                                                  None, "http://example.org/en/10?x", "http://example.org/en/2", "http://example.org/es"])]
    pages = pages.union(spark.createDataFrame(odd * 2, pages.schema))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect())
    rows = sorted(((r.page_id, *plain_rule(r.url)) for r in pages.collect()), key=lambda r: r[:3])
    assert [r[:4] for r in got] == [r[:4] for r in rows]
    assert all(a[4] == b[4] if b[4] else a[4] in ("allow", "block") for a, b in zip(got, rows))


def test_the_regression_learns_from_a_labelled_table(spark):
    rows = [(i, f"http://{'cheap-pills' if i % 2 else 'library'}{i}.net/p{i}", i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, label int")
    asked = spark.createDataFrame(
        [(i, f"http://{'cheap-pills' if i % 2 else 'library'}{i}.net/q") for i in range(500, 600)], "page_id long, url string"
    )
    got = url_filter.judge_urls(asked, rules=(), labelled=labelled).collect()
    assert all((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    one = url_filter.judge_urls(asked, rules=(), labelled=labelled.where("label = 0"))
    assert {(r.verdict, r.score) for r in one.collect()} == {("allow", None)}


# --- mixing

def goals(sizes: dict, weights=(3, 1, 2)) -> dict:
    """Targets in rounds: what a capped source leaves over is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, free, found = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = budget / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not full:
            return found | {s: unit * weight[s] for s in free}
        found |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(found[s] for s in full)
        free -= full
    return found


def test_the_mix_comes_near_its_targets(frame, sentence):
    rows = [(i, sentence(5 + i % 40), "en", ("web", "web", "web", "book", None, "code")[i % 6]) for i in range(1800)]
    plan = mixing.mix_plan(frame(rows))
    got = plan.collect()
    size = {i: len(plain.words(t)) for i, t, _, _ in rows}
    source = {i: s for i, _, _, s in rows}
    totals = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    want = goals(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == totals[s]
        assert r.target == pytest.approx(want[s]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 50 for s in totals)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_plan(frame(rows).repartition(7)).collect()))
    mixed = mixing.mix(frame(rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.taken // r["size"] for r in got if r.taken}


def test_many_sources_are_joined_by_salt(frame, sentence, monkeypatch):
    rows = [(i, sentence(3 + i % 20), "en", (None, *(f"s{k}" for k in range(40)))[i % 41]) for i in range(800)]
    want = sorted(map(str, mixing.mix_plan(frame(rows)).collect()))
    mixed = sorted(r.doc_id for r in mixing.mix(frame(rows)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(map(str, mixing.mix_plan(frame(rows)).collect())) == want
    assert sorted(r.doc_id for r in mixing.mix(frame(rows)).collect()) == mixed


def test_texts_stay_where_they_are(frame, sentence):
    docs = frame([(i, sentence(20), "en", "web") for i in range(50)])
    for df in (mixing.mix(docs), mixing.mix_plan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "Exchange hash" not in plan


def test_rows_without_an_id_are_chosen_by_their_text(frame, sentence):
    rows = [(None, sentence(20), "en", ("a", "b", "b")[i % 3]) for i in range(600)]
    plan = mixing.mix_plan(frame(rows)).collect()
    for source in {r.source_size for r in plan}:
        mine = [r for r in plan if r.source_size == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    assert len(plan) == 600 and all(r.doc_id is None for r in plan)
    mixed = mixing.mix(frame(rows)).collect()
    assert sum(len(plain.words(r.text)) for r in mixed) == sum(r.taken for r in plan) and mixed[0].gone == "gone"


def test_the_mix_of_odd_rows(frame, odd_rows):
    taken = sorted(str(r.doc_id) for r in mixing.mix(frame(odd_rows)).collect())
    assert set(taken) <= {str(r[0]) for r in odd_rows}
    assert mixing.mix(frame([])).collect() == []


# --- odd tables

@pytest.mark.parametrize("name", ["quality", "toxicity", "reject", "mix"])
def test_odd_rows_and_empty_tables(spark, frame, odd_rows, name):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    operator = {
        "quality": quality_rules.judge, "mix": mixing.mix_plan,
        "toxicity": lambda docs: toxicity.toxicity_scores(docs, labels),
        "reject": lambda docs: toxicity.without_toxic(docs, labels.where(F.lit(False))),
    }[name]
    got = operator(frame(odd_rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert operator(frame([])).collect() == []
