"""Decontamination, quality rules, secrets and line dedup."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from hearth.llm import decontaminate, line_dedup, quality, secrets
from hearth.llm.queries import RANKS, op2_decontaminate, op4_quality_rules, op6_secrets

from ..compare import assert_same, connect

ROWS = [(1, "Null is not here"), (2, None), (3, ""), (3, ""), (None, "x"), (5, " \n\t "), (6, "word " * 30_000)]


def frame(spark, rows, more="", extra=()):
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string{more}")


def test_decontamination_edge_cases(spark):
    docs = frame(spark, [*ROWS, (7, "say: ONE two É3 four, and one two é3 four"), (8, "one two é3")], ", n_hit int, spans string", (1, "s"))
    items = spark.createDataFrame([(10, "one TWO É3 four"), (9, "one two É3 four"), (11, None), (None, "x"), (12, "..."), (13, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    found = {(r["doc_id"]): r for r in decontaminate.scan(docs, items).collect()}
    # É isn't é: only A-Z change case
    assert found[7]["n_hit"] == 4 and found[7]["items"] == ["10", "9"] and [(s["begin"], s["end"]) for s in found[7]["spans"]] == [(5, 20)]
    assert not found[2]["contaminated"] and found[2]["n_words"] == 0 and found[6]["n_words"] == 30_000 and found[8]["n_hit"] == 0
    several = decontaminate.scan(docs, items, max_bytes=8)
    key = lambda d: sorted(str(r) for r in d.collect())
    assert key(several) == key(decontaminate.scan(docs, items))
    assert sorted(str(r["doc_id"]) for r in decontaminate.remove_contaminated(docs, items).collect()) == sorted(["1", "2", "3", "3", "None", "5", "6", "8"])
    assert key(decontaminate.remove_contaminated(docs, items, max_bytes=8)) == key(decontaminate.remove_contaminated(docs, items))
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    assert decontaminate.scan(docs.where("false"), items).collect() == [] and decontaminate.scan(docs, items.where("false")).where("contaminated").count() == 0


def test_long_items_match_by_window(spark):
    words = [f"w{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join(["a", *words[2:13], "b"])), (2, " ".join(words[:9]))])
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.scan(docs, items).collect()} == {1: 11, 2: 0}


def test_several_blocks_give_what_one_gives(spark):
    # item 1 has two rows with different texts, as question and answer; hits of different items overlap or follow each other
    rows = [("1", "red orange yellow"), ("1", "green blue violet"), ("2", "yellow green"), ("3", "blue violet black"), ("4", "white grey")]
    rows += [(str(i), f"filler{i} text{i}") for i in range(5, 60)] + rows[:2]
    items = spark.createDataFrame(rows, "item_id string, text string")
    texts = ["É red, orange; yellow. green blue violet - white grey", "red orange yellow x green blue violet", "blue violet black white grey", "nothing", "", None, "red orange yellow x green blue violet"]
    docs = frame(spark, [*enumerate(texts)])
    key = lambda d: sorted(str(r) for r in d.collect())
    one = decontaminate.scan(docs, items)
    assert [r["items"] for r in one.where("doc_id = 1").collect()] == [["1"]] and [len(r["spans"]) for r in one.where("doc_id = 0").collect()] == [1]
    for max_bytes in (500, 150):
        assert key(decontaminate.scan(docs, items, max_bytes=max_bytes)) == key(one)
    assert key(decontaminate.remove_contaminated(docs, items, max_bytes=100)) == key(decontaminate.remove_contaminated(docs, items)) == key(docs.where("doc_id in (3, 4, 5)"))


def test_only_workers_build_automata(spark):
    scanner = decontaminate.Scanner([("1", b"a b c")], 10)
    assert scanner.patterns is None and scanner.scan(b"x a b c")[1:] == ([1, 2, 3], ["1"])


def test_op2_equals_sql(spark, sf_dir):
    from hearth.llm.oracles import SQL

    assert_same(op2_decontaminate(spark, sf_dir), SQL["op2_decontaminate"], connect(sf_dir))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) for j in range(i, i + 3) if grams[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_quality_rules(spark, sf_dir).collect():
        n, chars, symbols, lines, repeats = brute_counts(docs[r["doc_id"]])
        failed = n < 50 or 100 * repeats > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeats, failed)
        assert not (failed and r["kept"])


def test_binomial_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.1), (7, 7, 0.3)):
        assert math.isclose(quality.at_most(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality.certify(1000, [0, 1, 500], 0.05, 0.01) == 2 and quality.certify(10, [0], 0.05, 0.01) == 0


def test_cutoffs_hold_their_risk(spark):
    good = "\n".join(" ".join(f"plain{i}x{j}" for j in range(10)) for i in range(8))
    bad = " ".join(f"w{i}### x{i}$$$" for i in range(40))
    rows = [(i, good, "en") for i in range(2000)] + [(i, bad, "en") for i in range(2000, 2100)] + [(9000, bad, "fr"), (9001, bad, None), (9002, None, "en"), (9003, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i in range(2100)] + [(77777, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[i] for i in range(2000, 2100))
    assert kept[9000] and kept[9001] and not kept[9002] and not kept[9003]
    stay = quality.keep_good(docs.withColumn("__x", F.lit(1)), labels)
    assert stay.columns == ["doc_id", "text", "lang", "__x"] and stay.count() == 2002
    assert quality.judge(docs.where("false"), labels).collect() == []
    assert sum(r["kept"] for r in quality.judge(docs, labels.where("false")).collect()) == 2102


def brute_verdicts(docs, labels, alpha=0.02, delta=0.05):
    """doc_id -> kept, from (doc_id, text, lang) and (doc_id, quality), with exact fractions throughout."""
    from fractions import Fraction

    def at_most(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    facts, failed, langs = {}, {}, {}
    for i, text, lang in docs:
        n, chars, symbols, lines, repeats = brute_counts(text)
        n_lines = sum(1 for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        facts[i] = {"symbols": symbols / max(n, 1), "dup_lines": lines / max(n_lines, 1), "repeat_words": repeats / max(n, 1), "word_chars": chars / max(n, 1)}
        failed[i], langs[i] = n < 50 or 100 * repeats > 50 * n, lang
    good = {i for i, q in labels if q == 1}
    by_lang = {}
    for i in facts:
        if i in good and not failed[i]:
            by_lang.setdefault(langs[i], []).append(i)
    share = Fraction(str(alpha)) / 4
    tested = {lang: ids for lang, ids in by_lang.items() if (1 - share) ** len(ids) <= Fraction(str(delta)) / 4}
    cutoffs = {}
    for lang, ids in tested.items():
        for rule, (_, _, grid) in quality.RULES.items():
            for c in grid:
                if at_most(sum(facts[i][rule] > c for i in ids), len(ids), share) > Fraction(str(delta)) / (4 * len(tested)):
                    break
                cutoffs[lang, rule] = c
    return {i: not failed[i] and not any(facts[i][r] > cutoffs.get((langs[i], r), math.inf) for r in quality.RULES) for i in facts}, cutoffs


def labelled_corpus(n_good=1500, seed=5):
    """Two languages with enough good labels and one without; texts on which different rules fire."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("la", "tor", "me", "nix", "po")]

    def text(kind):
        lines = [" ".join(r.choice(words) + str(r.randrange(1000)) for _ in range(8)) for _ in range(10)]
        if kind == "symbols":
            lines = [x.replace(" ", " ### ", 6) for x in lines]
        elif kind == "dup_lines":
            lines = [x for x in lines[:5]] + ["same"] * 20
        elif kind == "word_chars":
            lines = ["x".join(x.split()) + " " + "y" * r.randrange(8, 60) for x in lines] + [" ".join("z" * 25 + str(k) for k in range(45))]
        return "\n".join(lines)

    rows, labels = [], []
    for k, (lang, n) in enumerate((("en", n_good), (None, n_good), ("fr", 60))):
        for i in range(n + 60):
            doc = k * 10_000 + i
            # a few good texts look bad, so that the walk along a grid ends somewhere
            kind = "plain" if i < n and r.random() > 0.002 else r.choice(["symbols", "dup_lines", "word_chars"])
            rows.append((doc, text(kind), lang))
            labels.append((doc, int(i < n)))
    return rows, labels


def test_certified_cutoffs_equal_brute_force(spark, tmp_path):
    rows, labels = labelled_corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    expected, cutoffs = brute_verdicts(rows, labels)
    assert len({rule for _, rule in cutoffs}) >= 3 and {lang for lang, _ in cutoffs} == {"en", None}
    found = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in op4_quality_rules(spark, str(tmp_path)).collect()}
    assert {i: k for i, (k, _) in found.items()} == expected
    assert sum(not k and not b for k, b in found.values()) > 40
    from hearth.llm.oracles import SQL

    assert_same(op4_quality_rules(spark, str(tmp_path)), SQL["op4_quality_rules"], connect(str(tmp_path)))


def test_few_labels_walk_all_grids_at_once(spark, tmp_path):
    """Strata of 400 and 900 good labels beside one of 1,500: held against exact fractions and against SQL."""
    from fractions import Fraction

    from hearth.llm.oracles import SQL

    rows, labels = labelled_corpus(n_good=1500, seed=8)
    few, more = labelled_corpus(n_good=400, seed=9), labelled_corpus(n_good=900, seed=10)
    for shift, lang, (r, q) in ((100_000, "de", few), (200_000, "es", more)):
        rows += [(i + shift, t, lang) for i, t, was in r if was == "en"]
        labels += [(i + shift, x) for i, x in q if i < 10_000]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = op4_quality_rules(spark, str(tmp_path))
    assert_same(found, SQL["op4_quality_rules"], connect(str(tmp_path)))
    kept, good = {r["doc_id"]: r["kept"] for r in found.collect()}, {i for i, q in labels if q}
    for lang in ("de", "es"):
        facts = []
        for i, text, own in rows:
            n, chars, symbols, lines, repeats = brute_counts(text)
            if own == lang and n >= 50 and 100 * repeats <= 50 * n:
                n_lines = sum(1 for x in text.split("\n") if x.strip())
                facts.append((i, {"symbols": symbols / n, "dup_lines": lines / n_lines, "repeat_words": repeats / n, "word_chars": chars / n}))
        ours = [v for i, v in facts if i in good]
        beyond = lambda v, k: any(v[r] > quality.cutoff_at(r, k) for r in quality.RULES)
        p, size, passed = Fraction(2, 100), len(ours), 0
        while passed < quality.STEPS and sum(math.comb(size, i) * p**i * (1 - p) ** (size - i) for i in range(sum(beyond(v, passed) for v in ours) + 1)) <= Fraction(5, 400):
            passed += 1
        assert 0 < passed and {i: kept[i] for i, _ in facts} == {i: not beyond(v, passed - 1) for i, v in facts}
        assert sum(not kept[i] for i, _ in facts) > 20


def test_every_stratum_is_tested(spark):
    """More strata than a bound of a few hundred would let through."""
    rows = spark.range(300 * 900).selectExpr("id as doc_id", "concat('l', id % 300) as lang", "if(id % 900 < 2, 3.0D, 0.1D) as v")
    values = {"n_words": "100L", "word_chars": "500L", "n_symbols": "cast(v * 100 as long)", "n_dup_lines": "0L", "n_repeat_words": "0L", "n_lines": "10L"}
    counted = rows.selectExpr("doc_id", "lang", f"named_struct({', '.join(f'{k!r}, {v}' for k, v in values.items())}) as c")
    labels = rows.selectExpr("doc_id", "1 as quality")
    assert quality.calibrate(counted, "c", labels, alpha=0.06).where("repeat_words is not null").count() == 300


def test_quality_with_clashing_columns_and_long_texts(spark):
    rows = [(1, "Word " * 300_000, "en"), (2, " ".join(f"w{i}" for i in range(60)), None), (2, " ".join(f"w{i}" for i in range(60)), None), (None, None, None)]
    docs = frame(spark, rows, ", lang string, __n_words int, __counts int, __COUNTS_of int, kept int", (7, 8, 9, 10))
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    judged = quality.judge(docs, labels).collect()
    assert sorted((r["n_words"], r["kept"]) for r in judged) == [(0, False), (60, True), (60, True), (300_000, False)]
    stay = quality.keep_good(docs, labels)
    assert stay.columns == docs.columns and [(r["doc_id"], r["__n_words"], r["__COUNTS_of"]) for r in stay.collect()] == [(2, 7, 9)] * 2


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


CASES = [
    "é Password = 'hunter22' x", "token: abc", "api_key=\"abcdef\" apikey:ABCDEFG", "AKIA" + "A1" * 8, "AKIA short", "ff" * 12 + " " + "f" * 23, "secret=secret=abcdefg", "paſſword=abcdefg", "toKen=abcdefgh", "éé TOKEN = \"" + "0a" * 20 + "\"", "",
]


def test_random_spans_leave_out_what_base_spans_cover():
    with open(RANKS, "rb") as f:
        scanner = secrets.Scanner(f.read(), 8, 2.2)
    rng = random.Random(3)
    parts = ["0a" * 12, "token=abcdef1", "AKIA" + "B2" * 9, "x9Qz7Kp2Vw", "q8Z=token=w7Xk2Jv9", " ", "=", "/", "\n", "word", "é"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12))).encode()
        base = scanner.base(text)
        expected = [m.span() for m in secrets._CANDIDATE.finditer(text) if m.end() - m.start() >= 8 and not any(m.start() < e and s < m.end() for s, _, e in base) and scanner.is_random(m[0])]
        found = [(len(text.decode()[:a].encode()), len(text.decode()[:b].encode())) for a, k, b in scanner.scan(text) if k == 3]
        assert found == expected


def test_very_many_spans_in_one_text():
    with open(RANKS, "rb") as f:
        scanner = secrets.Scanner(f.read(), 20, 2.2)
    assert len(scanner.scan(b"0123456789abcdef01234567 " * 100_000)) == 100_000


def test_base_spans_equal_brute_force(spark, sf_dir):
    docs = frame(spark, [*enumerate(CASES), (100, None)], ", spans int, kind string", (1, "k"))
    for r in secrets.scan(docs, RANKS).collect():
        text = "" if r["doc_id"] == 100 else CASES[r["doc_id"]]
        assert ",".join(f"{s['kind']}:{s['begin']}:{s['end']}" for s in r["spans"] if s["kind"] != "random") == brute_base(text)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op6_secrets(spark, sf_dir).collect():
        assert r["base_sha256"] == hashlib.sha256(brute_base(texts[r["doc_id"]]).encode()).hexdigest()


def test_random_spans_of_the_query_equal_brute_force(spark, sf_dir, tmp_path):
    """Whole runs, from the query's spans, by a plain reading of the rule; parts must lie in what base spans leave."""
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("plain", pat_str=secrets.PIECES, mergeable_ranks=ranks, special_tokens={})
    identifier, uuid = re.compile(r"([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*", re.ASCII), re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

    def random_run(run):
        if len(run) < 20 or identifier.fullmatch(run) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)) or uuid.fullmatch(run):
            return False
        if len(run) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
            return False
        return len(run) / len(encoding.encode_ordinary(run)) < 2.2

    rng, signs = random.Random(9), "ABCDEFabcdefghijkxyz0123456789+/=_-"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for i in range(300):
        parts = ["".join(rng.choices(signs, k=rng.randrange(5, 60))), "token=abcdef1" + "x9" * rng.randrange(9), "settings/verification/", "é", "0a" * 16]
        texts[-1 - i] = " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(4))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = 0
    for r in op6_secrets(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        base = [(a, b) for k, a, b in spans if k not in ("random", "part")]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k not in ("random", "part")) == brute_base(text)
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/=_-]+", text)]
        touched = lambda a, b: any(x < b and a < y for x, y in base)
        assert [(a, b) for k, a, b in spans if k == "random"] == [(a, b) for a, b in runs if not touched(a, b) and random_run(text[a:b])]
        for k, a, b in spans:
            if k == "part":
                assert any(x <= a and b <= y for x, y in runs) and not touched(a, b) and random_run(text[a:b])
        n += sum(k in ("random", "part") for k, _, _ in spans)
    assert n > 100


def test_random_strings_are_found_and_identifiers_are_not(spark):
    texts = [
        "key x9Qz7LmP2vKt8RwY4bNc6HjD now", "id 123e4567-e89b-12d3-a456-426614174000 here", "sum d41d8cd98f00b204e9800998ecf8427e", "name some_long_identifier_2024_version_12", "word chheitschverheitenunglich", "1234567890123456789012345",
    ]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(frame(spark, list(enumerate(texts))), RANKS).collect()}
    assert found == {0: ["random"], 1: [], 2: ["hex"], 3: [], 4: [], 5: ["hex"]}


def test_random_parts_of_longer_runs_are_found(spark):
    rng = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts, wanted = [], []
    for i in range(200):
        secret = "".join(rng.choices(alphabet, k=18)) + "a7"
        before, after = [("production_database_credentials=", ""), ("/user/account/settings/verification/", "/overview/details"), ("AKIA" + "Q2" * 8 + "/", ""), ("é AKIA" + "Q2" * 8 + "=", "_" + "0a" * 12)][i % 4]
        texts.append(before + secret + after)
        wanted.append((len(before), len(before) + 20))
    docs = frame(spark, list(enumerate(texts)))
    for r in secrets.scan(docs, RANKS).collect():
        a, b = wanted[r["doc_id"]]
        assert any(s["kind"] in ("random", "part") and s["begin"] <= a and s["end"] >= b for s in r["spans"]), texts[r["doc_id"]]
    for r in secrets.redact(docs, RANKS).collect():
        a, b = wanted[r["doc_id"]]
        assert texts[r["doc_id"]][a:b] not in r["text"]
    names = "/user/account/settings/verification/notification/overview/details/information/"
    plain = [names + "v1/123e4567-e89b-12d3-a456-426614174000", names + "v1/" + "D41D8CD98F00B204E9800998ECF8427E", "AKIA" + "Q2" * 8 + "/user/account/settings/version2/verification"]
    assert [[s["kind"] for s in r["spans"]] for r in secrets.scan(frame(spark, list(enumerate(plain))), RANKS).orderBy("doc_id").collect()] == [[], [], ["access"]]


def test_a_very_long_run_takes_linear_time():
    with open(RANKS, "rb") as f:
        scanner = secrets.Scanner(f.read(), 20, 2.2)
    assert scanner.scan(b"verification/x1/" * 60_000) == [] and len(scanner.scan(b"verification/settings/x9Qz7LmP2vKt8RwY4bNc6HjD/" * 20_000)) in (1, 20_000)


def test_redaction(spark):
    docs = frame(spark, [(1, "é token=\"abcdef123\" end"), (2, "clean"), (3, None), (3, None)], ", n_chars long, spans string", (99, "s"))
    rows = {r["doc_id"]: r for r in secrets.redact(docs, RANKS, length="n_chars").collect()}
    assert rows[1]["text"] == "é [SECRET]\" end" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["n_chars"] == 99 and rows[3]["text"] is None
    assert secrets.redact(docs.where("false"), RANKS).collect() == []


def test_passage_dedup_edge_cases(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(2, f"{line}\nkeep é\n {line.upper()}  "), (1, f"first\n{line}"), (3, None), (4, ""), (5, "short"), (6, "short"), (None, line), (7, line), (7, line), (8, " \n\n\t")]
    docs = frame(spark, rows, ", removed int, hash long, __id int, __ID_ int, __hash int, __runs int", (1, 2, 3, 4, 5, 6))
    out = line_dedup.apply(docs, min_words=10)
    assert out.columns == ["doc_id", "text", "hash", "__id", "__ID_", "__hash", "__runs", "removed"]
    texts = sorted((str(r["doc_id"]), str(r["text"]), [(s["begin"], s["end"]) for s in r["removed"]]) for r in out.collect())
    n = len(line)
    assert texts == sorted([("2", "keep é", [(0, n), (n + 9, 2 * n + 11)]), ("1", f"first\n{line}", []), ("3", "None", []), ("4", "", []), ("5", "short", []), ("6", "short", []), ("None", "", [(0, n)]), ("7", "", [(0, n)]), ("7", "", [(0, n)]), ("8", " \n\n\t", [])])
    assert line_dedup.apply(docs.where("false")).collect() == []
    named = spark.createDataFrame([("b", f"x! {line}"), ("a", line)], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.apply(named, min_words=10).collect()} == {"a": line, "b": "x! "}


def test_passages_inside_and_across_lines(spark):
    sentences = [f"This is sentence number {i} of that long passage." for i in range(8)]  # 9 words each
    common = "A generic short line that many documents have here."
    rows = [(1, f"Begin. {' '.join(sentences)} End of one."), (2, f"{common}\nOther start here! {' '.join(sentences[:4])}\n{' '.join(sentences[4:])} Another end."), (3, f"{common}\nnothing else is alike"), (4, f"half a cut {' '.join(sentences)[25:]} Last.")]
    found = {r["doc_id"]: r for r in line_dedup.apply(frame(spark, rows)).collect()}
    assert found[1]["removed"] == [] and found[3]["removed"] == []
    assert found[2]["text"] == f"{common}\nOther start here! \nAnother end." and len(found[2]["removed"]) == 8
    assert [found[2]["text"] != "" and rows[1][1][s["begin"] : s["end"]].strip() for s in found[2]["removed"]] == sentences
    # a passage cut inside its first unit goes from its first whole unit on
    assert found[4]["text"].startswith("half a cut") and found[4]["text"].endswith(" Last.") and len(found[4]["removed"]) == 7


def brute_dedup(docs, min_words):
    """The kept text of each document, comparing every passage with all that stand before it."""
    before, out = set(), {}
    for i in sorted(docs):
        units = [(k, m.group()) for k, line in enumerate(docs[i].split("\n")) for m in re.finditer(r"\S.*?(?:[.!?](?=\s)\s+|$)", line)]
        words = [u.lower().split() for _, u in units]
        gone = set()
        for a in range(len(units)):
            b = a
            while b < len(units) and sum(map(len, words[a:b])) < min_words:
                b += 1
            passage = tuple(w for x in words[a:b] for w in x)
            if len(passage) >= min_words:
                if passage in before:
                    gone.update(range(a, b))
                before.add(passage)
        lines = []
        for k, line in enumerate(docs[i].split("\n")):
            mine = [j for j, (x, _) in enumerate(units) if x == k]
            if not mine or set(mine) - gone:
                lines.append("".join(units[j][1] for j in mine if j not in gone) if mine else line)
        out[i] = "\n".join(lines)
    return out


def test_passages_equal_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(120):
        parts = [" ".join(r.choice("abcdeF") for _ in range(r.randrange(1, 4))) + r.choice([". ", "! ", "\n", ".\n", " ", "?\n\n"]) for _ in range(r.randrange(15))]
        rows.append((i, "".join(parts)))
    rows.append((500, "a b. " * 20_000 + "end"))
    expected = brute_dedup(dict(rows[:-1]), 6)
    found = {x["doc_id"]: x["text"] for x in line_dedup.apply(frame(spark, rows), min_words=6).collect()}
    assert {i: found[i] for i in expected} == expected
    assert found[500].count("a b. ") <= 3 and found[500].endswith("end")


def test_op8_equals_sql(spark, sf_dir):
    from hearth.llm.oracles import SQL
    from hearth.llm.queries import op8_line_dedup

    assert_same(op8_line_dedup(spark, sf_dir), SQL["op8_line_dedup"], connect(sf_dir))
