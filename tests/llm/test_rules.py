"""Quality rules, PII, secrets, URLs, mixing and toxicity against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmap.llm import ORACLES, QUERIES, mixing, pii, quality, secret_scan, toxicity, url_filter

CONTRACT = {
    "op1": {"doc_id", "n_shingles", "component_id", "kept"},
    "op2": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op3": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5": {"page_id", "host", "path", "rule", "verdict"},
    "op6": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9": {"doc_id", "size", "source_size", "target", "taken"},
    "op10": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    assert CONTRACT[name.split("_")[0]] <= set(QUERIES[name](spark, SMALL).columns)


# --- quality


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40))
def test_suffix_array(words):
    ids = quality.word_numbers(words)
    order, lcp = quality.suffix_array(ids)
    want = sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
    assert order.tolist() == want

    def common(a, b):
        n = 0
        while max(a, b) + n < len(ids) and ids[a + n] == ids[b + n]:
            n += 1
        return n

    assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(want, want[1:])]
    # the union of maximal repeats is what repeated windows cover, and their lengths cannot grow
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    m = quality.measure(" ".join(words), 3)
    assert m[4] == len(places) and (m[6] == len(places) if m[7] >= 3 else m[6] == 0)
    for length, at in quality.maximal_repeats(ids, order, lcp, 2):
        parts = {tuple(ids[p : p + length]) for p in at}
        assert len(parts) == 1 and len(at) > 1
        assert len({ids[p - 1] if p else None for p in at}) > 1
        assert len({ids[p + length] if p + length < len(ids) else None for p in at}) > 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=4, max_size=60), st.integers(1, 8))
def test_coverage_is_the_union_of_all_maximal_repeats(words, least):
    ids = quality.word_numbers(words)
    spans = quality.maximal_repeats(ids, *quality.suffix_array(ids), least)
    m = quality.measure(" ".join(words), least)
    assert m[5] == len(spans)
    assert m[6] == len({p + k for length, at in spans for p in at.tolist() for k in range(length)})


def test_memory_of_a_repeated_word_is_linear():
    quality.measure("word " * 100)
    tracemalloc.start()
    got = quality.measure("word " * 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (4000, 16000, 0, 0, 4000, 3992, 4000, 3999)
    assert peak < 20e6


def test_long_repeats_and_covered_texts_go(spark):
    r = random.Random(1)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    clean, passage, short = text(400), text(70), text(10)
    rows = [(1, clean), (2, f"{clean} {passage} {text(5)} {passage}"), (3, f"{text(90)} " + f" {text(3)} ".join([short] * 5)), (4, f"{clean} {short} {text(9)} {short}"), (5, text(49))]
    got = {x.id: (x.kept, x.base_failed) for x in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (True, False), 5: (False, True)}


def test_labelled_good_documents_are_kept(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    out = quality.judge(d.join(good, "doc_id", "left_semi")).where("not base_failed")
    assert out.where("not kept").count() == 0


# --- personal data and secrets


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def hidden(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def crafted(seed, n=250):
    r = random.Random(seed)
    parts = ["a@b.c", "_d@e.f", "x.y%z@h-i.j.k", "@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111112", "+1 (555) 123-4567", "+49.89.1234", "++1234567890", "+1 2", "é", "日本", "👍", " ", "\n", "-", "+", "5500005555555559", "9" * 40,
             "token=abcdef", "token==abc12", "Password: 'hunter22'", "api_key\"=\"zzzzzzz", "apikey : q1w2e3", "secret=ab", "AKIA" + "Q" * 16, "AKIAQ", "AKIA" * 6, "deadbeef" * 3, "deadbeef" * 4, "xxdeadbeef", "tokentoken=abcdefg", "PASSWD=ABCDEF", "toKen='a+/_.=-b"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(n)]


def sha(spans):
    return hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()


@pytest.mark.parametrize(("name", "brute"), [("op4_pii_boosting", private), ("op7_secret_ledger", hidden)])
def test_base_spans_of_crafted_texts(spark, tmp_path, name, brute):
    texts = [*crafted(7), "9" * 20_000, "a" * 30_000 + "@" + "b." * 5_000 + "c", "1 " * 20_000, "f" * 50_000, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = brute(text or "")
        assert got[k].base_sha256 == sha(want), (text[:80], want[:3], got[k].spans)
        assert set(",".join("%s:%d:%d" % s for s in want).split(",")) <= set(got[k].spans.split(","))


def test_added_spans_and_redaction(spark):
    rows = [
        (1, "you can call 212-555-0187 or write to jane.doe [at] corner [dot] com today"),
        (2, "please pay to iban DE89 3704 0044 0532 0130 00 by monday"),
        (3, "order 1234567890 of part 555.123 and version 1:2:3:4:5:6:7:8 is 20 euro"),
        (4, "mail a@b.co from 10.0.0.1, phone +1 (212) 555-0187"),
        (5, "plain words only, at home. Then out"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r.id: sorted(s.kind for s in r.added) for r in pii.detect(df).collect()}
    assert kinds[1] == ["local_phone", "masked_email"] and kinds[2] == ["iban"]
    assert kinds[3] == kinds[5] == []
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[4] == "mail <email> from <ip>, phone <phone>" and text[5] == rows[4][1]
    assert "212" not in text[1] and "<masked_email>" in text[1]


#: Marked by hand: text, and the parts of it that are personal beyond the base kinds.
MARKED = [
    ("cards 4111 1111 1111 1111 5500 0055 5555 5559 on file", ["4111 1111 1111 1111", "5500 0055 5555 5559"]),
    ("two numbers 4111111111111111 5500005555555559 side by side", ["4111111111111111", "5500005555555559"]),
    ("one number 4111111111111112 5500005555555558 that fail", []),
    ("ring +1 (826) 555-4081 190.137.223.204 at night", ["+1 (826) 555-4081"]),
    ("from +44 207 555 0199 10.20.30.40 they said", ["+44 207 555 0199"]),
    ("write to jane.doe [at] corner [dot] com today", ["jane.doe [at] corner [dot] com"]),
    ("iban GB82 WEST 1234 5698 7654 32 please", ["GB82 WEST 1234 5698 7654 32"]),
    ("transfer to DE89370400440532013000 by monday", ["DE89370400440532013000"]),
    ("transfer to DE88370400440532013000 by monday", []),
    ("order 1234567890 of part 555.123 and version 1:2:3:4:5:6:7:8", []),
    ("serial 2390-4095-0064-8960 is on the box", []),
    ("sum of +0 (123) 456-7890 000.111.222.333", []),
    ("the years 1990 1991 1992 1993 1994 were dry", []),
    ("peer 2001:db8:85a3:8d3:1319:8a2e:370:7348 connected", ["2001:db8:85a3:8d3:1319:8a2e:370:7348"]),
    ("you can call 212-555-0187 until five", ["212-555-0187"]),
]


def test_hand_marked_personal_data(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MARKED)], "doc_id int, text string")
    got = {r.id: [s.value for s in r.added] for r in pii.detect(df).collect()}
    hits = sum(len(set(got[k]) & set(want)) for k, (_, want) in enumerate(MARKED))
    found, true = sum(map(len, got.values())), sum(len(want) for _, want in MARKED)
    assert hits == found and hits >= 0.8 * true, {MARKED[k][0]: (got[k], MARKED[k][1]) for k in got if got[k] != MARKED[k][1]}


def test_spans_added_to_the_corpus(spark):
    """Numbers side by side, which the base loses together, are found; numbers that fail their check stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9]{6}|[0-9]-[0-9]'")
    want = set()
    for r in docs.collect():
        held = [(s, e) for _, s, e in private(r.text)]
        parts = [m for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", r.text) if luhn(m[0])] + list(re.finditer(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", r.text))
        want |= {(r.doc_id, m.start(), m.end()) for m in parts if not any(s < m.end() and m.start() < e for s, e in held)}
    got = {(r.id, s.start, s.end) for r in pii.detect(docs).collect() for s in r.added}
    assert len(want) >= 3 and got == want


def test_held_out_examples_of_personal_data(spark):
    fresh = pii.training_examples(400, seed=99)
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(fresh)], "doc_id int, text string")
    got = {r.id: ([(s.start, s.end) for s in r.added], [(s.start, s.end) for s in r.base]) for r in pii.detect(df).collect()}
    found = {k: v[0] for k, v in got.items()}
    open_ = {k for k, (_, s, e) in enumerate(fresh) if not any(x < e and s < y for x, y in got[k][1])}
    hits = sum((s, e) in found[k] for k, (_, s, e) in enumerate(fresh) if s >= 0)
    wrong = sum(len([x for x in found[k] if x != (s, e)]) for k, (_, s, e) in enumerate(fresh))
    true = sum(s >= 0 for k, (_, s, _) in enumerate(fresh) if k in open_)
    assert hits / true > 0.6 and hits / (hits + wrong) > 0.9, (hits, wrong, true)


@pytest.mark.parametrize("most", [0, 1, 200_000])
def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", most)
    ledger = f"{tmp_path}/ledger"
    df = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("c", None)], "path string, content string")
    rows = lambda: spark.read.parquet(ledger).count()
    index = secret_scan.update(df, ledger)
    assert rows() == 2
    assert {r.path: len(r.findings) for r in secret_scan.report(index, ledger).collect()} == {"a": 1, "b": 1, "c": 0}
    secret_scan.update(df, ledger)
    assert rows() == 2
    more = df.unionByName(spark.createDataFrame([("a", "AKIA" + "B" * 16)], df.schema))
    index = secret_scan.update(more, ledger)
    assert rows() == 3 and secret_scan.report(index, ledger).count() == 4
    # a new version of one rule rescans with that rule alone and replaces its findings
    newer = tuple(secret_scan.Rule("assign", 2, r"nothing", "nothing") if r.name == "assign" else r for r in secret_scan.RULES)
    index = secret_scan.update(df, ledger, rules=newer)
    last = spark.read.parquet(ledger).where(F.array_contains("scanned", "assign@2")).collect()
    assert len(last) == 2 and all(r.scanned == ["assign@2"] for r in last)
    assert all(not r.findings for r in secret_scan.report(index, ledger, newer).collect())


# --- pages


def test_hosts_paths_and_rules(spark):
    r = random.Random(3)
    hosts = ["org", "A.ORG", "example.org", "www.Example.org", "xexample.org", "com", "a.com:80", "com.", "orgy", "net", ""]
    urls = [f"{r.choice(['http', 'x', ''])}{r.choice(['://', '://', ':/'])}{r.choice(hosts)}{r.choice(['', '/', '/es', '/es/a', '/en/1', '/en/12?x', '/fr/x#/de/', '/de/', '?/fr/', '#'])}{r.choice(['', '://z'])}" for _ in range(300)]

    def brute(url):
        at = url.find("://")
        if at < 0:
            return "", "", None
        host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [rule for _, rule in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        return host, path, max(fit, key=len, default=None)

    df = spark.createDataFrame([(k, u, "<p>x") for k, u in enumerate(urls)], "page_id int, url string, html string")
    verdict = {rule: v for v, rule in url_filter.RULES}
    for row in url_filter.judge(df).collect():
        assert (row.host, row.path, row.rule) == brute(urls[row.id])
        if row.rule:
            assert row.verdict == verdict[row.rule]


def test_reputation_shrinks_to_what_stands_above(spark):
    rows = [(f"{k}.bad.net", 1) for k in range(30)] + [(f"{k}.good.net", 0) for k in range(30)] + [("big.good.net", 1)] * 40 + [("big.good.net", 0)] * 2 + [("solo.good.net", 1)] + [("new.bad.net", None)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["solo.good.net"].mean < 0.8 < got["3.bad.net"].mean
    assert got["solo.good.net"].lower < 0.5 < got["big.good.net"].lower
    assert got["new.bad.net"].n == 0 and got["new.bad.net"].mean == pytest.approx(got["new.bad.net"].prior_mean)
    assert all(0 <= r.lower <= r.mean <= r.upper <= 1 for r in got.values())


def test_reputation_blocks_hosts_that_no_rule_names(spark):
    """On sf0.1 six hosts are named after what they sell; their pages' text is like that of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = [r for r in url_filter.judge(pages).collect() if r.rule is None]
    blocked = {r.host for r in rows if r.verdict == "block"}
    bad = {r.host for r in rows if re.search("casino|pills|spam|adult|bets|ads-", r.host)}
    assert len(bad) == 6 and blocked == bad
    neutral = {r.verdict for r in url_filter.judge(pages, bad=F.lit(None)).where("rule IS NULL").collect()}
    assert neutral == {"allow"}


def test_a_few_bad_pages_do_not_block(spark):
    url = lambda h, k: f"http://{h}/p{k}"
    rows = [(url(f"h{k % 40}.clean.net", k), int(k % 50 == 0)) for k in range(2000)] + [(url("new.clean.net", 1), 1), (url("only.one.xyz", 1), 1), (url("solo.clean.net", 2), 1)] + [(url("farm.bad.com", k), int(k % 10 > 0)) for k in range(60)] + [(None, 1)]
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id int, url string, outcome int")
    got = {r.host: r.verdict for r in url_filter.judge(df, bad=F.col("outcome")).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"farm.bad.com"}


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("www.x.com",), ("x.com",), ("localhost",), ("10.0.0.1",)], "h string")
    got = [r.d for r in df.select(url_filter.domain_of(F.col("h")).alias("d")).collect()]
    assert got == ["b.co.uk", "x.com", "x.com", "localhost", "10.0.0.1"]


# --- mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by capping and resharing until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / open_w for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_takings(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randrange(0, 300)), r.choice(["a"] * 20 + ["b", "c", "d", "é", "", None])) for k in range(1500)] + [(9000, None, "z"), (9001, "one", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=5_000, block_words=16).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes)
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source], rel=1e-9, abs=1e-9) and 0 <= g.taken <= 3 * g.size
        taken[g.source] += g.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 33
    assert len({g.shard for g in got if g.source == "a"}) > 5
    again = mixing.mix(df.repartition(7), shard_words=5_000, block_words=16)
    assert sorted((g.id, g.taken) for g in got) == sorted((g.id, g.taken) for g in again.collect())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 300))
def test_apportionment(spark, votes, total):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(votes)], "p int, v long")
    got = {r.p: r.seats for r in mixing.apportion(df, [], "p", "v", F.lit(total)).collect()}
    seats = [0] * len(votes)
    if any(votes):
        for _ in range(total):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * seats[k] + 1), -k))
            seats[best] += 1
    assert [got[k] for k in range(len(votes))] == seats


def test_repeated_rows_follow_the_mix(spark):
    df = spark.createDataFrame([(k, "w " * 50, "a" if k < 20 else "b") for k in range(120)], "doc_id long, text string, source string")
    n = Counter(r.source for r in mixing.repeat_rows(df, block_words=10).collect())
    assert n["a"] == 60 and n["b"] == 60


# --- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def registered(labelled):
    return toxicity.fit(*labelled)


def test_scores_are_the_sum_of_the_features_weights(registered):
    r = random.Random(8)
    names = [f.rstrip("-0123456789") for f in registered.weights]
    for _ in range(200):
        words = [r.choice(names) + r.choice(["", "x", "ment"]) for _ in range(r.randrange(30))]
        margin = registered.intercept + sum(registered.weights.get(f, 0) for f in toxicity.features(words))
        assert registered.score(words) == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -30, 30))), rel=1e-9)


def test_mentions_move_the_registered_model_less_with_the_penalty(spark, labelled, registered):
    """Mean change of the score of held-out harmless texts when one term of a set stands in for another."""
    docs, labels = labelled
    plain = toxicity.fit(docs, labels, fairness=0.0)
    harmless = docs.join(labels.where("toxic = 0"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").limit(150).collect()

    def gap(model):
        out = []
        for r in harmless:
            words = toxicity.words_of(r.text)
            for group in toxicity.IDENTITY:
                scores = [model.score([*words, t]) for t in group]
                out.append(max(scores) - min(scores))
        return sum(out) / len(out), max(out)

    before, after = gap(plain), gap(registered)
    assert before[0] > 0 and after[0] < 0.7 * before[0] and after[1] < before[1], (before, after)


def test_held_out_labels(spark, labelled, registered):
    (docs, labels), model = labelled, registered
    test = docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    scores = {r.id: r.score for r in toxicity.score(test, model).collect()}
    truth = {r.doc_id: r.toxic for r in test.select("doc_id", "toxic").collect()}
    hit = sum(scores[i] >= 0.3 for i, t in truth.items() if t)
    assert hit / sum(truth.values()) > 0.85
    assert sum(scores[i] >= 0.3 for i, t in truth.items() if not t) / len(truth) < 0.02
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in truth)


def test_a_neutral_mention_of_a_group_does_not_raise_the_score(spark):
    r = random.Random(4)
    fill = lambda: " ".join(r.choice("tree road lamp door rain stone cloud bread".split()) for _ in range(12))
    rows = []
    for k in range(400):
        toxic = k % 2
        group = "muslim" if r.random() < (0.9 if toxic else 0.1) else "christian"
        rows.append((k, f"{fill()} {group} {'you vile fool' if toxic and r.random() < 0.8 else ''} {fill()}", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    gap = {}
    for fairness in (0.0, 20.0):
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), fairness=fairness)
        gap[fairness] = abs(model.score("the muslim went home".split()) - model.score("the christian went home".split()))
        assert model.score("you vile fool".split()) > 0.5
    assert gap[20.0] < 0.4 * gap[0.0]
    assert toxicity.swapped("a plain text".split()) is None
    assert np.isfinite(model.score([]))
