"""Filter audit, secret scan and conversation trie against brute force, on odd tables and on hot keys."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from judgeline.llm import common, filter_audit, prefix_trie, secrets
from judgeline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"
NAMES = ("row", "part", "fails", "kind", "start", "hash", "owner", "c", "at", "node", "depth", "digest", "good", "words", "n")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def put(spark, folder, name, schema, rows, clash=True):
    df = spark.createDataFrame(rows, schema)
    for extra in NAMES if clash else ():
        df = df.withColumn(extra, F.lit(extra))
    df.write.parquet(f"{folder}/{name}.parquet")


# --- filter audit ------------------------------------------------------------------------------------------------

def test_lattice_counts_paths():
    for n in range(1, 6):
        edges = filter_audit.lattice(n)
        assert len(edges) == n * 2 ** (n - 1)
        passes = Counter((s, b) for _, _, s, b in filter_audit.orders([str(i) for i in range(n)]))
        assert passes == Counter({(s, b): w for s, b, w in edges})


def brute_audit(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *m in labels if m[at] == 1} - {None} for at in (0, 1))
    parts = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[lang or ""].append((i, {f for f, bad in fails.items() if bad}))
    out = {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                left = [(i, fails) for i, fails in left if f not in fails]
                failing = sum(f in fails for _, fails in rows)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(fails == {f} for _, fails in rows),
                    sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for f in "ABCDE":
            keys = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def audited_docs():
    rng = random.Random(3)
    many = [" ".join(rng.choice(["aa", "bb", "Cc", "DDD", "e#", "f"]) + str(rng.randrange(90)) for _ in range(n))
            for n in (0, 3, 99, 100, 101, 150, 400)]
    texts = [None, "", " \t\n ", "A" * 20, "é" * 200, "x|y", *many, " ".join(f"w{i}" for i in range(30_000))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s", 1) for i in range(200)]
    return rows + [(None, "Same.", None, None, None), (7, "Same.", "en", "a", 1), (7, "Same.", "en", "a", 1), (3, "Same.", "en", "a", 1)]


@pytest.mark.parametrize("labels", [[], [(i % 90, i % 2, i % 3 if i % 5 else None) for i in range(100)] + [(None, 1, 1)]])
def test_audit_equals_brute_force(spark, tmp_path, labels):
    docs = audited_docs()
    put(spark, tmp_path, "documents", DOCS, docs)
    put(spark, tmp_path, "labels", "doc_id long, quality int, toxic int", labels, clash=False)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in QUERIES["op11_filter_audit"](spark, str(tmp_path)).collect()}
    assert got == brute_audit(docs, labels)


def test_audit_of_nothing(spark, tmp_path):
    put(spark, tmp_path, "documents", DOCS, [])
    put(spark, tmp_path, "labels", "doc_id long, quality int, toxic int", [])
    assert QUERIES["op11_filter_audit"](spark, str(tmp_path)).collect() == []


# --- secrets -----------------------------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


HEX = hashlib.md5(b"x").hexdigest()
FOUND = [
    "secret=token:abcdefgh", "password==abc==def", "PassWord\": 'abcdef'", "paſſword=abcdefgh", "api_key = a.b.c.d.e",
    "api_keytoken=123456", "token=" + HEX, f"é😀 {HEX} AKIAAKIA{'Z9' * 8}", "AKIA" + "A" * 15, "AKIAAKIAAKIA" + "B" * 12,
    "secret:'12345' token:123456", "token\n=abcdefgh", "tokentoken=tokentoken=tokens", HEX[:23], None, "", "f" * 100_000,
    "secret=short secret=" + "long" * 3, "token=token=token=token=", "passwd = \"a+b/c=\"",
]


def test_base_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    alphabet = ["token", "secret", "=", ":", " ", "\"", "'", "api", "_", "key", "AKIA", "Z", "9", "a", "é", "\n", "ff0", HEX]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(FOUND)]
    rows += [(100 + i, "".join(rng.choice(alphabet) for _ in range(80)), None, None, 1) for i in range(300)]
    rows += [(None, "token=abcdefgh", None, None, None), (1, FOUND[1], "en", "s", 1)]
    put(spark, tmp_path, "documents", DOCS, rows)
    got = QUERIES["op12_secret_scan"](spark, str(tmp_path)).collect()
    want = Counter()
    for i, t, *_ in rows:
        spans = base_spans(t or "")
        kinds = Counter(k for _, k, _ in spans)
        want[i, kinds[0], kinds[1], kinds[2], hashlib.sha256(listed(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_copied_examples_and_live_keys(spark, monkeypatch):
    copied, live, shared, opaque = "a1b2c3d4e5f6", "q9w8e7r6t5y4", "z1x2c3v4b5n6", "Zk39fLq82mTx0PwVb71r"
    rows = [(i, f"token={copied}", f"o{i % 7}") for i in range(300)]
    rows += [(300, f"password={live} and {opaque}", "o1"), (301, f"password={live}", "o1"), (302, "password=changeme1", "o9")]
    rows += [(303, f"token={shared}", "o1"), (304, f"token={shared}", None), (305, f"token=other1 {copied.upper()}abcdefgh1A", "o2")]
    monkeypatch.setattr(common, "HOT", 4)
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), F.col("doc_id"))
    got = {r.doc_id: [(s["name"], s["verdict"], s["owners"], s["repos"]) for s in r.spans] for r in out.collect()}
    assert len(got) == 306 and all(got[i] == [("assign", "example", 7, 300)] for i in range(300))
    assert got[300] == [("assign", "live", 1, 2), ("opaque", "live", 1, 1)] and got[301] == got[300][:1]
    assert got[302] == [("assign", "example", 1, 1)]
    assert got[303] == got[304] == [("assign", "shared", 2, 2)]
    assert [s[0] for s in got[305]] == ["assign", "opaque"]


def test_secrets_of_nothing(spark, tmp_path):
    put(spark, tmp_path, "documents", DOCS, [])
    assert QUERIES["op12_secret_scan"](spark, str(tmp_path)).collect() == []


# --- conversations -----------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return Counter(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
         hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest())
        for s, m in members.items())


def trie(spark, tmp_path, rows):
    put(spark, tmp_path, "conversations", TALK, rows)
    return Counter(map(tuple, QUERIES["op13_conversation_trie"](spark, str(tmp_path)).collect()))


def test_trie_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 120), *range(-130, -95), 5000, 5001, 777_777]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["hi", "yes", "é😀", None, ""]) if turn else rng.choice(["hi", "hello"])
            rows.append((c, turn, rng.choice(["user", "bot", None]), text))
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(7)]  # one conversation, many times
    rows += [(c, t, "user", f"nested {t}") for c in range(1000, 1012) for t in range(c - 995)]  # each a prefix of the next
    rows += [(300, t, "user", "a" * (t % 3)) for t in range(300)]  # a long chain
    rows += [(400, None, "user", "null turn"), (400, 1, None, None), (400, 1, "bot", "tie"), (400, 1, "bot", "tie"), (None, 1, "user", "x")]
    assert trie(spark, tmp_path, rows) == brute_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert trie(spark, tmp_path, []) == Counter()


def test_subtree_sums_on_odd_shapes(spark):
    """A caterpillar with long legs, a star and a path: spines become unary only after their legs are raked."""
    parents, last = {0: None}, 0
    for i in range(12):
        spine = max(parents) + 1
        parents[spine], leg = last, spine
        for _ in range(12 - i):
            new = max(parents) + 1
            parents[new], leg = leg, new
        last = spine
    for _ in range(60):
        parents[max(parents) + 1] = 5
    want = {n: 0 for n in parents}
    for n in parents:
        at = n
        while at is not None:
            want[at] += n + 1
            at = parents[at]
    tree = spark.createDataFrame([(n, p, n + 1) for n, p in parents.items()], "node long, parent long, v long")
    assert {r.node: r.v for r in prefix_trie.subtree_sums(tree, ["v"]).collect()} == want
