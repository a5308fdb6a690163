"""Every operator against a brute-force version on small tables with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ridewave.llm import decontaminate as dc
from ridewave.llm import line_dedup as ld
from ridewave.llm import mixing as mx
from ridewave.llm import quality as ql
from ridewave.llm import secret_scan as ss
from ridewave.llm import token_files as tf
from ridewave.llm.common import Words
from ridewave.llm.components import components
from ridewave.llm.fingerprints import document_fingerprints, signatures
from ridewave.llm.fm_index import FMIndex
from ridewave.llm.html_text import extract_text, main_text
from ridewave.llm.queries import vocabulary_path
from ridewave.llm.simhash import keep_one, links, near_duplicates
from ridewave.llm.substring_dedup import substring_dedup
from tests.llm.fixtures import documents, passage, rows_of, texts_of

LEAST = -2**63


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op1 -------------------------------------------------------------------------------------------------------

def cut_by_force(rows, window):
    first = {}
    for doc, text in rows:
        ws = words_of(text)
        for s in range(len(ws) - window + 1):
            at, key = (LEAST if doc is None else doc, s), tuple(ws[s:s + window])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, text in rows:
        ws = words_of(text)
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s:s + window])] < (LEAST if doc is None else doc, s):
                gone.update(range(s, s + window))
        out.append((doc, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"busy": 2}, {"most_words": 50}])
def test_substring_dedup(spark, settings):
    df = documents(spark)
    assert rows_of(substring_dedup(df, **settings)) == cut_by_force(texts_of(df), 20)


def test_substring_dedup_other_window_and_text(spark):
    df = documents(spark)
    got = substring_dedup(df, window=8, gram=3, with_text=True)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == cut_by_force(texts_of(df), 8)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got.collect())
    assert substring_dedup(df.limit(0)).count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    lengths = np.array([100, 60, 240])
    index = FMIndex(words, lengths, 6)
    bounds = np.cumsum(lengths)
    ends = np.array([e for e in range(6, 401) if not any(e - 6 < b < e for b in bounds)])
    matched, low, high = index.search(index.symbols(words), ends, 6)
    assert (matched == 6).all()
    seen = Counter(tuple(words[e - 6:e]) for e in ends)
    assert [seen[tuple(words[e - 6:e])] for e in ends] == (high - low).tolist()
    absent = index.search(index.symbols(np.array([9, 9, 1, 2, 1, 2], np.uint64)), np.array([6]), 4)[0]
    assert absent[0] <= 4 and index.symbols(np.array([99], np.uint64))[0] == -1


# op2 -------------------------------------------------------------------------------------------------------

def test_line_dedup(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    cut = lambda t: [x.strip(" \t\n\r\x0b\f") for x in (t or "").split("\n")]
    sites: dict[str, set] = {}
    for _, text, source in rows:
        for line in cut(text):
            sites.setdefault(line, set()).add(source)
    for least in (2, 5):
        gone = {x for x, s in sites.items() if x and len(s) >= least}
        want = [(d, sum(bool(x) for x in cut(t)), sum(x in gone for x in cut(t)), "\n".join(x for x in cut(t) if x not in gone)) for d, t, _ in rows]
        assert rows_of(ld.line_dedup(df, min_sites=least)) == sorted(want, key=repr)
    assert ld.line_dedup(df.limit(0)).count() == 0


def test_line_spread_beyond_the_exact_mode(spark):
    """Sketches are estimates for many sites; lines near the threshold are counted exactly."""
    lines = spark.range(4).selectExpr("id AS line", "explode(sequence(1, 3994 + 4 * CAST(id AS INT))) AS n").selectExpr("line", "CAST(n AS STRING) AS site")
    assert rows_of(ld.widespread_lines(lines, 4000)) == [(2,), (3,)]


# op3 -------------------------------------------------------------------------------------------------------

def reshared(sizes, weights, share, most):
    """The rule as written: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {s: 0.0 for s in order}, set(order), share * sum(sizes.values())
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: target[s] + rest * weight[s] / total for s in open_}
        rest = 0.0
        for s, x in give.items():
            cap = most * sizes[s]
            target[s] = min(x, cap)
            rest += max(0.0, x - cap)
            if x >= cap:
                open_.discard(s)
    return target


def test_mixing_plan(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["source"], len(words_of(r["text"]))) for r in df.collect()]
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = reshared(sizes, (5, 2, 1), 1.5, 2.0)
    plan = mx.mixing_plan(df)
    got = plan.withColumnRenamed("doc_id", "d").collect()
    assert sorted(((r["d"], r["size"]) for r in got), key=repr) == sorted(((d, n) for d, _, n in rows), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken: dict = {}
    for r in got:
        taken.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    want: dict = {}
    for s in sizes:
        key = (sizes[s], round(target[s], 6))
        want[key] = want.get(key, 0) + int(target[s] + 1e-9)
    assert {k: sum(v) for k, v in taken.items()} == {k: v for k, v in want.items()}
    assert rows_of(plan) == rows_of(mx.mixing_plan(df.repartition(5)))  # reruns agree
    assert mx.mixing_plan(df.limit(0)).count() == 0


def test_mix_reads_what_the_plan_takes(spark):
    df = documents(spark)
    mixed = mx.mix(df)
    assert mixed.columns == df.columns
    got: Counter = Counter()
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"]) and r["text"]
        got[r["doc_id"]] += len(words_of(r["text"]))
    want: Counter = Counter()
    for r in mx.mixing_plan(df).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == Counter({k: v for k, v in want.items() if v})


# op4 -------------------------------------------------------------------------------------------------------

def simhash_by_force(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words_of(lower)
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    base = documents(spark)
    long = passage(77, 900).split()
    near = [(200 + i, " ".join(long[:500 + i] + ["Neu"] + long[501 + i:]), "s0") for i in range(6)]
    df = base.unionByName(documents(spark, near)).unionByName(documents(spark, [(300, "", "x"), (301, "Eins", "x"), (302, "eins", "x")]))
    rows = texts_of(df)
    prints = [(LEAST if d is None else d, simhash_by_force(t)) for d, t in rows]
    nodes = sorted({p for _, p in prints})
    root = components_by_force(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict = {}
    for d, p in prints:
        least[root[p]] = min(least.get(root[p], d), d)
    plain = lambda d: None if d == LEAST else d
    want = sorted(((plain(d), f"{p:016x}", plain(least[root[p]])) for d, p in prints), key=repr)
    assert rows_of(near_duplicates(df)) == want
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert len(rows_of(kept)) == len(set(root.values()))
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance,parts", [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (3, 4), (5, 3)])
def test_links_find_every_pair_once_or_more(spark, distance, parts):
    rng = np.random.default_rng(distance * 10 + parts)
    values = {int(v) for v in rng.integers(-2**62, 2**62, 5)}
    for v in list(values):
        for _ in range(12):
            mask = 0
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                mask |= 1 << int(b)
            x = (v ^ mask) & (2**64 - 1)
            values.add(x - 2**64 if x >= 2**63 else x)
    values |= {-1, 0, LEAST, 3}
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in links(df, distance, parts).collect()}
    listed = sorted(values)
    want = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert got == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200 - i, 199 - i) for i in range(30)] + [(500, 501), (501, 502), (502, 500)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**dict.fromkeys(range(91), 0), **dict.fromkeys(range(170, 201), 170), **dict.fromkeys((500, 501, 502), 500)}


# op5 -------------------------------------------------------------------------------------------------------

def jaccard(a, b):
    a, b = Counter(words_of(a)), Counter(words_of(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_document_fingerprints(spark):
    df = documents(spark)
    rows = sorted(((LEAST if d is None else d, t or "") for d, t in texts_of(df)))
    got = document_fingerprints(df).collect()
    assert len(got) == len(rows)
    by_text: dict = {}
    texts = {}
    for r in got:
        texts.setdefault(LEAST if r["doc_id"] is None else r["doc_id"], []).append(r)
    off = []
    for i, (d, t) in enumerate(rows):
        if len(texts[d]) > 1:  # the order of different texts under one id is by hash
            continue
        after = rows[(i + 1) % len(rows)]
        if len(texts[after[0]]) > 1:
            continue
        r, cut = texts[d][0], len(t) // 4
        edited = t[:len(t) - cut] + after[1][:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        off += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, after[1]))] if t.strip() and after[1].strip() else []
        by_text.setdefault(t, set()).add(r["fingerprint"])
    assert np.mean(off) < 0.06
    assert all(len(v) == 1 for v in by_text.values())
    assert document_fingerprints(df.limit(0)).count() == 0
    assert [r["near_next"] for r in document_fingerprints(documents(spark, [(1, "ein Wort", "s")])).collect()] == [1.0]


def test_signatures_estimate_weighted_jaccard():
    a = "x " * 30 + "y " * 10 + " ".join(f"w{i}" for i in range(40))
    b = "x " * 15 + "y " * 20 + " ".join(f"w{i}" for i in range(20, 60))
    one, two = signatures([a.encode(), b.encode()], 4096)
    assert abs((one == two).mean() - jaccard(a, b)) < 0.03


# op6 -------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy this</div><article><h1>Head&amp;Line</h1><p>First &lt;b&gt;  para&eacute;<br>goes
on.</p><p><b>Open <i>markup<p>Next one.</p><form><input name="q"><label>Mail</label></form><aside>Side</aside>
<div class="comments"><div><p>Reader says</p></div><p>More</p></div><p>Last &amp;amp; least.</p></article><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert main_text(PAGE) == "Head&Line\n\nFirst <b> paraé goes on.\n\nOpen markup\n\nNext one.\n\nLast &amp; least."
    assert main_text(PAGE.split("<p>Last")[0]) == "Head&Line\n\nFirst <b> paraé goes on.\n\nOpen markup\n\nNext one."


def test_main_text_by_line_blocks_alone():
    text = [passage(i, 40) for i in range(4)]
    links_ = "".join(f'<li><a href="/{i}">A link of some length {i}</a></li>' for i in range(20))
    page = f"<body><ul>{links_}</ul><div>{text[0]}</div><p>{text[1]}</p><p>{text[2]} <a href=x>linked</a></p><div>{text[3]}</div><ul>{links_}</ul></body>"
    assert main_text(page) == "\n\n".join([text[0], text[1], text[2] + " linked", text[3]])
    assert main_text("") == "" and main_text("<p>short</p>") == "" and main_text("<script>x") == ""


def test_extract_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x"), (None, "v", "<main><p>" + "a " * 20000 + "</main>", "x")],
                               "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in extract_text(df).collect()}
    assert got[1, "u"]["text"] == main_text(PAGE) and got[1, "u"]["n_chars"] == len(main_text(PAGE))
    assert got[2, None]["text"] == "" and got[None, "v"]["n_chars"] == 39999
    assert extract_text(df).count() == 4 and extract_text(df.limit(0)).count() == 0


# op7 -------------------------------------------------------------------------------------------------------

KEYS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = [("assign", re.compile(rf"""(?:{KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def base_by_force(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


SECRETS = ["token=token:abcdefghijk", 'é API_KEY : "abcd.efgh=ij" und passwd=kurz', "x" * 50 + " AKIA" + "Q1" * 8 + "AKIA AKIAZ", "0123456789abcdef" * 3 + "G" + "ab" * 15,
           "ſecret=abcdefghij secret=abcdefghij", "", None, "ToKeN='aaaaaaaa' SECRET= bbbbbbbbb;passWord:\tcccccccccc", "token=" + "0af9" * 12 + " token=" + "1bc" * 11 + " end " * 3000,
           "Kfj8sL2mQ0zXv7TtB1nWcR5y und ordinary_identifier_name_of_things", "secretsecret==abcdefgh"]


def test_secret_scan(spark):
    df = documents(spark, [(i, t, "s") for i, t in enumerate(SECRETS)] + [(99, SECRETS[0], "s"), (99, SECRETS[0], "s"), (None, SECRETS[1], "s")])
    df = df.unionByName(documents(spark, [(1000 + i, " ".join(f"{a}_{b}_{a}" for a, b in zip(passage(i, 60).split(), passage(i + 1, 60).split())), "s") for i in range(20)]))
    got = ss.secret_digest(df).collect()
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        want = base_by_force(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == sha(joined), text[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == i for x in want) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    added = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("markov")] for r in got}
    assert added[9] == ["markov:0:24"] and not added[1000]
    assert ss.secret_digest(df.limit(0)).count() == 0


def test_markov_ratios_tell_random_from_ordinary(spark):
    df = documents(spark, [(i, " ".join(["user_account_settings_page", "internationalization", "get_default_language_name"] * 4 + [passage(i, 30).replace(" ", "")]), "s") for i in range(60)])
    asked = documents(spark, [(i, t, "s") for i, t in enumerate(["zQ8vK3xJw7PfR2mTyB5nLc", "user1_account_settings_name", "9tVx0WqE4rLkZp8HsJ2dMbCy"])])
    found = {r["doc_id"]: len(r["added"]) for r in ss.find_secrets(df.unionByName(asked.selectExpr("doc_id + 500 AS doc_id", *asked.columns[1:]))).collect()}
    assert found[500] == 1 and found[501] == 0 and found[502] == 1


# op8 -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 1 << 18, (1 << 18) + 1, 600_001])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = tf.pack(values)
    assert len(control) == -(-n // 4) and (tf.unpack(control, data, n) == values).all()


ODD = ["a  b", " lead", "trail ", "x\n\ny", "tab\t z", " nbsp  x", "a \x1cb", "we're it's 12 345", "end\n", "\r\n crlf", "émoji 😀 ok", "<|endoftext|> x<|endoftext|> y", "3×4 ÷2 é×é", "a\n\nb c\n\n", "x\ny\tz", "¿qué? «ja» 12ª ½ ǅ ɐx", "ab12cd_3-4...x", "\n", " ", "don't 'tis", "٣٤ 漢字 a漢b", "e\u0301 x", "a  b", "a  b", "a ​b"]


def test_encoding_equals_the_library():
    tokenizer = tf.encoder(vocabulary_path()).tokenizer
    texts = ODD + [passage(i, 50) + ".\n" + passage(i + 1, 20) + ", " for i in range(30)] + [""]
    got = [x.tolist() for x in tf.encode_texts(texts, vocabulary_path())]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, tmp_path):
    df = documents(spark).unionByName(documents(spark, [(900 + i, t, "s") for i, t in enumerate(ODD)]))
    tokenizer = tf.encoder(vocabulary_path()).tokenizer
    path = str(tmp_path / "files")
    tf.write_token_files(df, path, vocabulary_path(), block_tokens=500)
    got = tf.read_token_files(spark, path).orderBy("start").collect()
    want = sorted(((LEAST if d is None else d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in texts_of(df)))
    read = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got]
    assert sorted(read) == want and [d for d, _ in read] == [d for d, _ in want]
    assert [r["start"] for r in got] == [0, *np.cumsum([len(x) for _, x in read]).tolist()[:-1]]
    digest = {(r["start"]): r for r in tf.token_digest(df, vocabulary_path()).collect()}
    assert all(digest[r["start"]]["ids_crc32"] == zlib.crc32(r["ids"]) and digest[r["start"]]["n_tokens"] == r["n_tokens"] for r in got)
    ranks = spark.read.parquet(path + "/ranks").orderBy("rank").collect()
    counts = Counter(t for _, x in want for t in x)
    assert [(r["token"], r["n"]) for r in ranks] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert tf.token_digest(df.limit(0), vocabulary_path()).count() == 0


# op9 -------------------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits_by_force(text, items):
    ws = plain_words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = plain_words(item)
        k = min(10, len(iw))
        grams = {tuple(iw[s:s + k]) for s in range(len(iw) - k + 1)} if iw else set()
        for s in range(len(ws) - k + 1):
            if k and tuple(ws[s:s + k]) in grams:
                hit.update(range(s, s + k))
                found.add("null" if name is None else str(name))
    return ws, hit, found


def contaminated_table(spark):
    item = [passage(i, 24) for i in range(1, 6)]
    items = [(1, item[0]), (2, item[1]), (10, " ".join(item[0].split()[5:18]) + " neu"), (3, "drei kurze Wörter"), (4, None), (5, " .!"), (None, item[2]), (2, item[1]), (7, "wort"), (8, "a b a b a b a b a b a b a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [item[0].upper(), f"x {item[0]} y {item[1]}!", "vor " + " ".join(item[1].split()[3:13]) + " nach", " ".join(item[1].split()[3:12]), "die DREI, kurze wörter.", None, "", "drei kurze",
             "ein wort hier; Wort", "b a b a b a b a b a b a", f"{item[2]}-{item[2]}", passage(50, 3000) + " " + item[3], " ".join(item[0].split()[:6] + item[0].split()[5:])]
    return documents(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(99, texts[1], "s"), (99, texts[1], "s"), (None, texts[2], "s")]), bench, items


@pytest.mark.parametrize("most_words", [2_000_000, 60])
def test_contamination(spark, most_words):
    docs, bench, items = contaminated_table(spark)
    want = []
    for d, t in texts_of(docs):
        ws, hit, found = hits_by_force(t, items)
        want.append((d, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    assert rows_of(dc.contamination(docs, bench, most_words=most_words)) == sorted(want, key=repr)
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert not dc.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_decontaminate_cuts_spans(spark):
    docs, bench, items = contaminated_table(spark)
    kept = dc.decontaminate(docs, bench, most_coverage=0.9)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    for r in docs.collect():
        ws, hit, _ = hits_by_force(r["text"], items)
        if len(hit) > 0.9 * len(ws):
            assert r["doc_id"] not in got
        else:
            assert plain_words(got[r["doc_id"]]["text"]) == [w for i, w in enumerate(ws) if i not in hit]
            assert (r["text"] == got[r["doc_id"]]["text"]) == (not hit)
    assert got[2]["text"] == "vor  nach" and got[2]["n_chars"] == 9


def test_automaton_matches_brute_force_on_random_words():
    rng = np.random.default_rng(5)
    for _ in range(60):
        items = [(f"i{k}", [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 14))]) for k in range(5)]
        words = [b"%d" % x for x in rng.integers(0, 4, 60)]
        machine = dc.SuffixAutomaton(items, 4)
        ranges, found = machine.scan(words)
        hit, names = set(), set()
        for name, iw in items:
            k = min(4, len(iw))
            grams = {tuple(iw[s:s + k]) for s in range(len(iw) - k + 1)}
            for s in range(len(words) - k + 1):
                if tuple(words[s:s + k]) in grams:
                    hit.update(range(s, s + k))
                    names.add(name)
        assert {i for a, b in ranges for i in range(a, b)} == hit and {machine.names[i] for i in found} == names


# op10 ------------------------------------------------------------------------------------------------------

def quality_tables(spark):
    docs, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = passage(i, 50) if good else " ".join(w.upper() + "!!" for w in passage(i, 50).split())
        docs.append((i, text, "s"))
        if i < 200:
            labels.append((i, int(good), 0))
    docs += [(300, None, "s"), (301, "", "s"), (302, passage(1, 50), "s"), (302, passage(1, 50), "s"), (None, passage(2, 50), "s"), (303, "Wort " * 30000, "s")]
    labels += [(300, None, 0), (1, 1, 0), (302, 0, 0), (302, 1, 0), (None, 1, 0), (999, 1, 0)]
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_scores(spark):
    docs, labels = quality_tables(spark)
    rows = ql.quality_scores(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(r["predicted"], int(d % 3 > 0)) for d, r in got.items() if d is not None and d < 240 and (r["held_out"] or d >= 200)]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert got[300]["score"] == got[301]["score"] and got[302]["score"] == got[1]["score"]
    kept = ql.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_quality_without_teachers(spark):
    docs, labels = quality_tables(spark)
    assert {r["score"] for r in ql.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert ql.quality_scores(docs.limit(0), labels).count() == 0
    one = [r["score"] for r in ql.quality_scores(docs, labels.where("quality = 1")).collect()]
    assert len(set(one)) == 1 and one[0] > 0.9


def test_training_never_sees_held_out_labels(spark):
    docs, labels = quality_tables(spark)
    flipped = labels.withColumn("quality", ql.F.when(ql.held_out(), 1 - ql.F.col("quality")).otherwise(ql.F.col("quality")))
    assert rows_of(ql.quality_scores(docs, labels)) == rows_of(ql.quality_scores(docs, flipped))


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4)).astype(np.float32)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = ql.fit(x[:3000], y[:3000])
    p = net.score(x[3000:])
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[3000:][part].mean()) < 0.1


def test_words_are_those_of_bytes_split():
    texts = [b"", b" a  b\t\n", "é ß\x1cx".encode(), b"x"]
    words = Words(texts)
    got = [[bytes(words.data[a:b]) for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first, words.first[1:])]
    assert got == [t.split() for t in texts]
