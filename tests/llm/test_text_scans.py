"""Secrets, licenses and decontamination against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from fixtures import EDGE, LONG, SF, contaminated, edge, smith_waterman

from curatorium.llm import decontam, licenses, registry, secrets, store

registry.load_all()
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, 0),
    "hex": (r"[0-9a-f]+", 0, 24, 0),
}


def base_spans(text):
    found = [(k, *m.span()) for k, (p, g, n, f) in KINDS.items() for m in re.finditer(p, text or "", f) if len(m[g]) >= n]
    return sorted(found, key=lambda s: (s[1], list(KINDS).index(s[0])))


def _check_secrets(rows, texts):
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_secrets_of_a_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").collect()}
    rows = registry.QUERIES["op1_secrets"](spark, f"{SF}/../sf0.01").collect()
    assert len(rows) == len(texts)
    _check_secrets(rows, texts)


def test_base_patterns_on_random_text():
    rng = random.Random(5)
    bits = ["password", "secret", "token", "API_KEY", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "0f", "AKIA", "ABCD1234", "a" * 24, "é", "\n", "K", "ſecret", "x1y2z3w4"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert [s[:3] for s in secrets.scan(text) if s[0] != "literal"] == base_spans(text)


def test_literals_reach_sensitive_names():
    text = "a = \"Zx81kd9Qm\"\nb='q9Zt7Lp'\ndb_pwd = a + b\n{\"client_key\": \"kd81JDk2kd\"} <passphrase>corr3ct-horse</passphrase> key: none of this pass the test"
    found = {text[s[1] : s[2]] for s in secrets.scan(text)}
    assert found == {"Zx81kd9Qm", "q9Zt7Lp", "kd81JDk2kd", "corr3ct-horse"}
    masked = secrets.mask(text, secrets.scan(text))
    assert not any(x in masked for x in found) and masked.count("[REDACTED]") == 4


def test_all_literals_of_a_constant_reach_the_name():
    values = [f"Zx{k:03d}kd9Qm" for k in range(300)]
    chain = "k = ''\n" + "".join(f'k = k + "{v}"\n' for v in values)
    for text in ("k = " + " + ".join(f'"{v}"' for v in values) + "\ndb_pwd = k", chain + "db_pwd = k", chain + "auth = k\ndb_pwd = k"):
        spans = secrets.scan(text)
        assert [text[s[1] : s[2]] for s in spans] == values and {s[4] for s in spans} == {"db_pwd"}
        assert secrets.mask(text, spans).count("[REDACTED]") == 300
    start = time.process_time()
    secrets.scan("k = k + 'Zx81kd9Qm'\npwd = k\n" * 20_000)
    assert time.process_time() - start < 5


def test_literals_of_subscripts_types_and_broken_lines():
    one, two = "Zx81kd9Qm", "q9Zt7Lp"
    forms = [
        'config["password"] = "{}"', "os.environ['API_KEY'] = '{}'", 'a["b"][ "db_pwd" ]="{}"', 'password: str = "{}"', 'const apiKey: string = "{}";',
        'db_pwd:str="{}"', 'token: Optional[str] = "{}"', 'secret: Dict[str, List[int]] = "{}"', 'secret: str | None = "{}"', "let token: &'static str = \"{}\";",
        'val pwd: String? = "{}"', 'x: Map<String, std::string> = "a" + "b"; pwd: std::string = "{}"', 'note: passphrase = "{}"',
    ]
    for form in forms:
        text = form.format(one)
        assert text[text.index(one) :].startswith(one) and one in {text[s[1] : s[2]] for s in secrets.scan(text)}, form
        assert one not in secrets.mask(text, secrets.scan(text))
    for form in ('db_pwd = "{}" +\n    "{}"', "db_pwd = ('x'\n db_pwd = '{}'\n  + '{}'", 'db_pwd = "{}" + \\\n "{}"', 'b = "{1}"\ndb_pwd = "{0}" +\r\n b'):
        text = form.format(one, two)
        assert {one, two} <= {text[s[1] : s[2]] for s in secrets.scan(text)}, form
    for form in ('a: {}\n+pwd: {}', ' "a": "{}"\n+ "db_pwd": "{}"', "a = {}\n+ pwd = {}", "a = '{}'\n+c['pwd'] = '{}'"):
        text = form.format(one, two)
        assert {text[s[1] : s[2]] for s in secrets.scan(text)} == {two}, form
    assert not secrets.scan('if config["password"] == "Zx81kd9Qm" or token: pass')
    for text in ("pwd: a[" * 30_000, "pwd: a" + " " * 200_000 + "x", "pwd: a[" + " b" * 100_000, "pwd=a" + "\n" * 200_000, "pwd='a'" + "\n+" * 100_000, "pwd:a|b" + "|c" * 100_000, "pwd:" + "a::b" * 50_000, 'c["pwd"' + " " * 200_000):
        start = time.process_time()
        secrets.scan(text)
        assert time.process_time() - start < 5


def test_literals_of_further_source_forms():
    one, two = "Zx81kd9Qm", "q9Zt7Lp"
    forms = [
        'db_pwd = f"{}"', "db_pwd = b'{}'", 'db_pwd = rb"{}"', 'db_pwd = @"{}";', 'db_pwd = """{}"""', "passphrase = \'\'\'{}\'\'\'", 'auth = ("user", "{}")', 'db_pwds_secret = ["{}", "b"]',
        'secret = ["x", "{}"]', 'let db_pwd = String::from("{}");', 'db_pwd = SecretStr("{}")', 'db_pwd = str(bytes("{}"))', 'setPassword("{}");', "client.set_token('{}')",
        'builder.password("{}").build()', 'map.put("password", "{}")', "os.environ.setdefault('API_KEY', '{}')", 'pw = db_pwd = "{}"', 'db_pwd = pw = x = "{}"', 'secret = (\n  "{}",\n)',
    ]
    for form in forms:
        text = form.format(one)
        assert one in {text[s[1] : s[2]] for s in secrets.scan(text)}, form
        assert one not in secrets.mask(text, secrets.scan(text)), form
    # parts that only together are a secret
    for form in ('db_pwd = "aB3d" + "{}"', 'a = "aB3d"\ndb_pwd = a + "{}"', 'a = "aB3d"\nb = a + "{}"\ndb_pwd = b'):
        text = form.format("E6gH")
        assert {text[s[1] : s[2]] for s in secrets.scan(text)} == {"aB3d", "E6gH"}, form
    text = f'auth = ("{one}", "{two}")'
    assert {text[s[1] : s[2]] for s in secrets.scan(text)} == {one, two}
    for text in (
        'db_pwd = getpass("Enter1abc: ")', 'db_pwd = os.getenv("DB_PWD_9x")', 'client.getSecret("db/Path1x")', 'put("password", "user_password")', 'db_pwd = "see " + name + ", thanks"', 'auth = {"user": "Zx81kd9Qm"}',
        'x = ("password", "is not set 1")', 'db_pwd = a["Zx81kd9Qm"]', 'pwd = pwd2 = x', 'if pwd == x == "Zx81kd9Qm": pass',
    ):
        assert not secrets.scan(text), text
    for text in ('pwd="""' * 30_000, "pwd=(" * 50_000, 'pwd=("a",' * 30_000, "pwd=a(" * 50_000, "pwd=a=" * 50_000, 'k = k + k + "Zx81kd9Qm"\n' * 5_000 + "pwd = k", '.pwd("' * 50_000, '("pwd","' * 50_000, "pwd=new " * 50_000, "pwd=((((" * 20_000, "pwd=" + "a::" * 100_000):
        start = time.process_time()
        secrets.scan(text)
        assert time.process_time() - start < 5, text[:20]


def test_masking_keeps_the_name():
    text = 'password=abcdef0123 and token = "feedfacefeedfacefeedface" end'
    assert secrets.mask(text, secrets.scan(text)) == 'password=[REDACTED] and token = "[REDACTED]" end'


def test_long_hostile_texts_are_linear():
    for text in ("a=b+" * 30_000 + "key", "a.b-" * 30_000 + "key", "--key-" * 30_000, "key='" * 30_000, "a" * 300_000 + "key", "<key>" * 30_000):
        start = time.process_time()
        secrets.scan(text)
        assert time.process_time() - start < 5


def test_awkward_rows_of_the_scans(spark):
    store.ship(spark)
    df = edge(spark)
    found = {r["doc_id"]: r for r in secrets.find_secrets(df, redact=True).where("doc_id is not null").collect()}
    assert found[1]["spans"] == [] and found[1]["redacted"] is None and found[2]["redacted"] == "" and len(found[12]["spans"]) == 3
    assert secrets.find_secrets(df).count() == len(EDGE) and secrets.find_secrets(df.limit(0)).count() == 0
    assert all(not r["licenses"] for r in licenses.find_licenses(df).collect())
    assert licenses.find_licenses(df.limit(0)).count() == 0


def test_licenses_of_a_table(spark):
    names = {
        "Licensed under the Apache License, Version 2.0": "Apache-2.0", "Released under the MIT License": "MIT",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    }
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").collect()}
    rows = registry.QUERIES["op10_licenses"](spark, f"{SF}/../sf0.01").collect()
    assert len(rows) == len(texts) and sum(r["n_licenses"] for r in rows)
    for r in rows:
        want = [v for k, v in names.items() for _ in range((texts[r["doc_id"]] or "").upper().count(k.upper()))]
        if not re.search(r"[#*$%&|!]{2}", texts[r["doc_id"]] or ""):
            assert r["n_licenses"] == len(want) and r["licenses"] == ",".join(sorted(set(want)))


def _find(text):
    templates = licenses.Templates(licenses.TEMPLATES)
    words, _ = licenses.W.plain_words(pa.array([text], pa.string()))
    return licenses.find(words, templates, np.arange(len(templates.all)))


def test_license_copies_with_changes():
    full = licenses.TEMPLATES["MIT"][2].split()
    full[5] = "XX"
    full.insert(20, "foo")
    del full[40]
    (found,) = _find(" ".join(["hello", "world", *full, "bye"]))
    assert found[0] == "MIT" and found[1] == 2 and found[3] == 84
    assert len(_find(" ".join([licenses.TEMPLATES["MIT"][2]] * 3))) == 3
    assert [f[0] for f in _find(licenses.TEMPLATES["GPL-2.0"][1])] == ["GPL-2.0"]
    assert not _find("Licensed under the Apache License") and not _find(" ".join(full[:30])) and not _find(LONG)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_told_from_its_neighbours(name):
    rng = random.Random(name)
    for text in licenses.TEMPLATES[name]:
        whole = text.split()
        assert {f[0] for f in _find(" ".join(["hello", "there", *whole, "and", "more"]))} == {name}, text
        if len(whole) > 3 * licenses.SHORT:
            templates = licenses.Templates({name: [text]})
            told = set().union(*licenses.Templates(licenses.TEMPLATES).telling[_index(text)], set())
            for _ in range(5):
                # words that tell nothing apart may change
                edited = [w if i in told or rng.random() > 0.06 else f"other{i}" for i, w in enumerate(whole)]
                got = _find(" ".join(edited))
                assert [f[0] for f in got] == [name], text
                words = licenses.W.plain_words(pa.array([" ".join(edited)], pa.string()))[0].tolist()
                assert got[0][3] <= _common(words, templates.all[0].words)


def _index(text):
    return [t for group in licenses.TEMPLATES.values() for t in group].index(text)


def _common(a, b):
    """Length of the longest common subsequence, cell by cell."""
    above = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(above[j] + 1 if x == y else max(above[j + 1], now[j]))
        above = now
    return above[-1]


def test_finds_equal_an_aligner_of_all_cells(spark):
    """Notices with random edits among junk: found exactly where the longest common subsequence covers the template."""
    rng = random.Random(12)
    templates = licenses.Templates({"A": ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"]})
    size, least = 20, licenses.needed(20)
    for _ in range(300):
        text = [w if rng.random() > 0.2 else f"x{rng.randrange(99)}" for w in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()]
        words = licenses.W.plain_words(pa.array([" ".join(["junk", *text, "junk"])], pa.string()))[0]
        common = _common(words.tolist(), templates.all[0].words)
        got = licenses.find(words, templates, [0])
        assert bool(got) == (common >= least) and all(f[3] == common and f[4] == size for f in got)


def test_changed_names_of_licenses_are_others():
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    for word, name in (("Lesser ", "LGPL-3.0"), ("Affero ", "AGPL-3.0"), ("", "GPL-3.0")):
        assert [f[0] for f in _find(gpl.replace("GNU ", f"GNU {word}"))] == [name]
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    numbered = two.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    assert [f[0] for f in _find(numbered)] == ["BSD-2-Clause"] and [f[0] for f in _find(three)] == ["BSD-3-Clause"]
    assert [f[0] for f in _find("// SPDX-License-Identifier: GPL-2.0-or-later */")] == ["GPL-2.0"]
    assert [f[0] for f in _find("# SPDX-License-Identifier: MIT\n" + two)] == ["MIT", "BSD-2-Clause"]
    assert not _find("SPDX-License-Identifier: Foo, then MIT")


def test_license_copies_with_a_long_insertion():
    full = licenses.TEMPLATES["MIT"][2].split()
    foreign = [f"foreign{i}" for i in range(len(full) // 2)]
    for at in (20, 42, 70):
        (found,) = _find(" ".join(["hello", *full[:at], *foreign, *full[at:], "bye"]))
        assert found == ("MIT", 1, 1 + len(full) + len(foreign), len(full), len(full))
    twice = [*full[:42], *foreign, *full[42:], *foreign] * 2
    assert [f[3] for f in _find(" ".join(twice))] == [len(full)] * 2
    assert not _find(" ".join([*full[:42], *foreign * 3, *full[42:]]))


def test_patience_alignment_is_increasing_and_equal():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))
        assert len(licenses.patience(a, a)) == len(a)


def test_increasing_subsequence_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        order = list(range(9))
        rng.shuffle(order)
        best = [1] * 9
        for i in range(9):
            best[i] = 1 + max((best[k] for k in range(i) if order[k] < order[i]), default=0)
        assert len(licenses._increasing(list(enumerate(order)))) == max(best)


def test_contamination_equals_alignment_of_all_pairs(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"] for r in registry.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert got == {i for i, t in texts.items() if contaminated(t, items)} and 0 < len(got) < len(texts)


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(9)
    vocabulary = [f"term{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(12)]
    rows = []
    for k, item in enumerate(items):
        own = item.split()
        for _ in range(6):
            own[rng.randrange(40)] = "changed"
        del own[rng.randrange(len(own))]
        around = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(2)]
        rows.append((2 * k, f"{around[0]} {' '.join(own)} {around[1]}".upper(), k))
        rows.append((2 * k + 1, f"{around[0]} {around[1]}", -1))
    docs = spark.createDataFrame(rows + [(None, items[0], 0), (99, None, -1), (98, "", -1), (0, rows[0][1], 0)], "doc_id long, text string, planted int")
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, "too short"), (102, items[0])], "item_id long, text string")
    store.ship(spark)
    got = decontam.decontaminate(docs.selectExpr("*", "'x' as contaminated"), bench).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r["contaminated"] == (r["planted"] >= 0) and (r["best_item"] if r["contaminated"] else -1) == r["planted"]
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(edge(spark), bench).count() == len(EDGE)


def test_exact_copy_beside_many_edited_copies(spark):
    item = [f"plain{i}" for i in range(20)]
    edited = [f"other{i}" if i % 5 == 4 else w for i, w in enumerate(item)]
    rows = [(0, " ".join(item)), *[(i, " ".join(edited)) for i in range(1, 1001)], (1001, " ".join(item[:3]) + " and nothing else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    store.ship(spark)
    got = {r["doc_id"]: r["score"] for r in decontam.contamination(docs, bench).collect()}
    assert got == {0: 40, **dict.fromkeys(range(1, 1001), decontam.MATCH * 16 - 3)}


def test_long_verbatim_part_of_a_long_item(spark):
    item = [f"plain{i}" for i in range(200)]
    parts = {0: item[100:128], 1: item[:20], 2: item[-19:], 3: item[50:62] + ["other"] + item[63:73]}
    docs = spark.createDataFrame([(k, " ".join(["before", *part, "behind"])) for k, part in parts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[100:159]))], "item_id long, text string")
    store.ship(spark)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(docs, bench).collect()}
    assert got == {(0, 7): 56, (0, 8): 56, (1, 7): 40, (3, 7): 43}


def test_recall_by_density_of_edits(spark):
    """Copies with every k-th word replaced: all that reach the score down to one edit in five words, most down to one in four."""
    rng = random.Random(21)
    common = [f"very{i}" for i in range(30)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"rare{rng.randrange(5000)}" for _ in range(rng.choice([12, 20, 40, 90]))] for _ in range(60)]
    rows, every = [], [4, 5, 6, 8, 12]
    for k, item in enumerate(items):
        for e in every:
            shift = rng.randrange(e)
            rows.append((k * 100 + e, " ".join([*rng.choices(common, k=50), *[f"new{i}" if i % e == shift else w for i, w in enumerate(item)], *rng.choices(common, k=50)])))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    store.ship(spark)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    shares = {}
    for e in every:
        due = [(k * 100 + e, k) for k, item in enumerate(items) if smith_waterman(rows[k * len(every) + every.index(e)][1].split(), item) >= min(max(len(item), 16), 40)]
        shares[e] = sum(x in got for x in due) / len(due)
    assert all(shares[e] == 1 for e in every if e > 4) and shares[4] > 0.9, shares


def test_seeds_are_the_rare_grams(spark):
    """A gram that most texts hold makes no pair by itself; a copy of the item is found by what else it has."""
    store.ship(spark)
    item = "which of the following " + " ".join(f"w{i}" for i in range(16))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    items = decontam.items_of(bench)
    grams = {tuple(r["grams"]) for r in items.collect()}.pop()
    hits = spark.createDataFrame([(0, grams[0], i) for i in range(500)] + [(1, g, 0) for g in grams], "place long, gram long, at int")
    seeds = {r["gram"]: r["seed"] for r in decontam.seeds_of(items, hits).collect()}
    assert not seeds[grams[0]] and sum(seeds.values()) == len(grams) - 3


def test_reach_follows_the_items_of_a_gram(spark):
    store.ship(spark)
    long = [f"long{i}" for i in range(600)]
    items = decontam.items_of(spark.createDataFrame([(1, " ".join(long)), (2, "tiny little thing")], "item_id long, text string"))
    tables = decontam.gram_table(items), decontam.reach_table(items)

    class Held:
        value = tables

    words = [f"x{i}" for i in range(3000)]
    words[1500:1503] = "tiny", "little", "thing"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text_key": [1, 2, 3], "text": [" ".join(words), " ".join(["a", *long[:3], *words[:1490]]), "tiny little thing and tiny little thing"]})
    places = [r for b in decontam._places(Held)(iter([batch])) for r in b.to_pylist()]
    assert [len(p["words"]) for p in places] == [3 + 2 * 16, 4 + 1024, 7] and [p["at"] for p in places] == [[16], [1], [0, 4]]
