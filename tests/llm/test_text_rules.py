"""Quality rules, secrets, URL filters and toxicity beside brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tanteo.llm import quality_rules, secrets, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(docs):
    source = random.Random(3)
    texts = ["".join(source.choice(["a", "b", "é", " ", "\n", "\t", "#", " "]) for _ in range(source.randint(0, 200))) for _ in range(200)]
    texts += [None, "", " \n ", "a b c a b c", "a b c a b c a b c", "x " * 30_000]
    found = quality_rules.measured(docs(*texts)).collect()
    assert {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in found} == {i: counted(t) for i, t in enumerate(texts)}


def test_verdict_does_not_depend_on_the_order(docs, prose):
    frame = docs(prose(80, 1), prose(10, 2), "same words here " * 40, prose(80, 3).upper(), prose(80, 4).replace(" ", "%%% "), None)
    rules = quality_rules.default_rules()
    assert quality_rules.estimate(frame, rules)[0].rejected > 0
    assert {r.doc_id for r in quality_rules.kept(frame).collect()} == {0}
    assert quality_rules.kept(frame).columns == frame.columns
    assert {r.doc_id for r in quality_rules.judged(frame, rules[::-1]).where("kept").collect()} == {0}
    assert quality_rules.judged(frame.limit(0)).count() == 0


def test_a_rejected_row_costs_no_later_count(spark, docs, prose, monkeypatch):
    """A count that fails on one text: only a cascade that rejects the text first gets through."""
    frame = docs("bad", prose(80, 1), prose(80, 2).upper())
    counts = quality_rules._counts

    def failing(text):
        late = ("n_letters", "n_upper", "n_lines")
        return {n: F.when(text == "bad", F.raise_error(F.lit("late"))).otherwise(c) if n in late else c for n, c in counts(text).items()}

    order = [r.name for r in quality_rules.default_rules()]
    steps = lambda names: lambda *_: [quality_rules.Estimate(n, 0.1, 1.0) for n in names]
    monkeypatch.setattr(quality_rules, "_counts", failing)
    monkeypatch.setattr(quality_rules, "estimate", steps(order))
    assert [r.doc_id for r in quality_rules.kept(frame).collect()] == [1]
    assert {r.doc_id: r.failed_rule for r in quality_rules.judged(frame).collect()} == {0: "few_words", 1: None, 2: "upper_case"}
    monkeypatch.setattr(quality_rules, "estimate", steps(order[::-1]))
    for run in (quality_rules.kept, quality_rules.judged):
        with pytest.raises(Exception, match="late"):
            run(frame).collect()


def test_columns_of_any_name_stay(spark, prose):
    row = (1, prose(80, 1), 7, "w", 0.5, "n")
    frame = spark.createDataFrame([row], "doc_id int, text string, _words int, n_words string, `a.b` double, c0 string")
    assert [tuple(r) for r in quality_rules.kept(frame).collect()] == [row] and quality_rules.kept(frame).columns == frame.columns
    found = quality_rules.judged(frame).first()
    assert (found["_words"], found["n_words"], found["a.b"], found["kept"]) == (7, 80, 0.5, True)


BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_spans_equal_regular_expressions():
    source = random.Random(1)
    parts = ["password", "token", "SECRET", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "é", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "dead", ".", ",", "\n", "+/"]
    texts = ["".join(source.choice(parts) for _ in range(source.randint(0, 40))) for _ in range(4_000)] + ["", "f" * 100_000]
    for text, spans in zip(texts, secrets.scan(pa.array(texts)), strict=True):
        assert [s for s in spans if s[0] in BASE] == base_spans(text)


def test_secrets_keep_rows_and_are_removed(docs):
    frame = docs("é password=abcdefgh end", None, "", "nothing", "-----BEGIN RSA PRIVATE KEY----- x")
    rows = {r.doc_id: r for r in secrets.scanned(frame).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[0].spans] == [("assign", 2, 19)] and rows[0].source == "x"
    assert rows[1].spans == rows[2].spans == rows[3].spans == [] and rows[4].spans[0].kind == "private_key"
    clean = {r.doc_id: r.text for r in secrets.redacted(frame).collect()}
    assert clean == {0: "é [secret] end", 1: None, 2: "", 3: "nothing", 4: "[secret] x"}
    assert secrets.scanned(frame.limit(0)).count() == 0


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_longest_rule_wins_and_the_model_learns(spark):
    urls = [f"https://good.site{i}.com/garden/flowers/{i}" for i in range(60)] + [f"http://w{i}.net/es/xxqz{i}qzzx" for i in range(60)]
    odd = [None, "no scheme", "HTTP://A.EXAMPLE.COM/en/x?y", "http://www.example.com/en/1", "http://example.com", "http://b.org/garden/flowers/7", "http://c.org/xxqz5qzzx"]
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + odd + odd[-1:])], "page_id bigint, url string, host int")
    rows = {r.page_id: r for r in url_filters.judged(frame, RULES).collect()}
    assert len(rows) == len(urls) + len(odd) + 1
    at = len(urls)
    assert (rows[at].host, rows[at].path, rows[at].rule, rows[at + 1].host) == ("", "", None, "")
    assert (rows[at + 2].host, rows[at + 2].rule, rows[at + 2].verdict) == ("a.example.com", "example.com/en/", "block")
    assert (rows[at + 3].rule, rows[at + 3].verdict) == ("www.example.com/en/", "allow")
    assert (rows[at + 4].path, rows[at + 4].rule) == ("", None)
    assert (rows[at + 5].verdict, rows[at + 6].verdict, rows[at + 7].verdict) == ("allow", "block", "block")
    assert url_filters.judged(frame.limit(0), RULES).count() == 0


@pytest.fixture
def labelled(spark, prose):
    rows = []
    for i in range(300):
        text = prose(60, i)
        toxic = i % 3 == 0
        rows.append((i, text[:200] + (" villainous " if toxic else " ") + text[200:], int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_lexicon_is_learned_folded_and_matched(spark, labelled, prose):
    lexicon = toxicity.fit(labelled)
    texts = ["you v1llainous " + prose(40, 900), "Vіllаinous", "clean words only", None, "", prose(3000, 901) + " villainous villainous villainous"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity.scored(frame, lexicon).collect()}
    assert scores[0] > 0.5 and scores[1] > 0.5 and max(scores[i] for i in (2, 3, 4)) < 0.5 and scores[3] == scores[4]
    none = toxicity.fit(labelled.where("toxic = 0"))
    assert toxicity.scored(frame, none).where("score >= 0.5").count() == 0
    assert toxicity.fit(labelled.limit(0)).words == {}


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({"nasty": 5.0}, {}, frozenset({"nasty weather"}))
    matcher = toxicity.Matcher(lexicon)
    assert matcher.strength("a nasty, weather report") == 0 and matcher.strength("a nasty man") > 0 and matcher.strength("dynasty") == 0


def test_exceptions_reach_over_any_gap():
    lexicon = toxicity.Lexicon({"nasty": 5.0}, {}, frozenset({"nasty weather", f"{'very' * 40} nasty"}))
    matcher = toxicity.Matcher(lexicon)
    for gap in (" ", " " * 30, " " * 90, " -\n" * 100_000):
        assert matcher.strength(f"nasty{gap}weather") == 0.0 < matcher.strength(f"nasty{gap}day")
        assert matcher.strength(f"{'very' * 40}{gap}nasty") == 0.0
    assert matcher.strength("weather nasty") > 0


def test_ids_are_chosen_without_texts(spark):
    ids = spark.range(100).withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50, 200)] + [(7, None), (None, 1), (8, 5)], "doc_id bigint, toxic int")
    found = toxicity.chosen(ids, labels, texts=10).collect()
    assert len(found) == 20 and all(50 <= r.doc_id < 100 and r.toxic == r.doc_id % 2 for r in found)
    assert toxicity.chosen(ids, labels).count() == 50 and toxicity.chosen(ids, labels.limit(0)).count() == 0


def test_secrets_take_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "password=abcdefgh1", 2, 3), (2, None, None, None)], "doc_id int, text string, `a.b` int, c0 int")
    assert secrets.scanned(frame).columns == [*frame.columns, "spans"] and len(secrets.scanned(frame).orderBy("doc_id").first().spans) == 1
    assert [tuple(r) for r in secrets.redacted(frame).orderBy("doc_id").collect()] == [(1, secrets.MARK, 2, 3), (2, None, None, None)]
