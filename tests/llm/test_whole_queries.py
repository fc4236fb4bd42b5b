"""Registered queries without SQL against plain versions of the whole of them, one row after another."""

import re
from collections import Counter, defaultdict

import numpy as np
import zstandard

from quern.llm import quality, queries, textbytes as tb, tokens, toxicity, wrappers
from test_quality import plain as walked


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statistics(text):
    data = (text or "").encode()
    words = data.lower().split()
    if not words:
        return [0.0] * len(quality.NAMES)
    n, dark = len(words), sum(map(len, words))
    lower = bytes.lower
    count = lambda flags: sum(flags[b] for b in data)
    again = lambda items: sum(c - 1 for c in Counter(items).values())
    lines = [line.strip(b" \t\r\x0b\x0c") for line in data.split(b"\n")]
    lines = [line for line in lines if line]
    keys = [lower(line) for line in lines]
    first = {}
    for k, x in enumerate(keys):
        first.setdefault(x, k)
    twice = [k for k, x in enumerate(keys) if first[x] != k]
    runs = [tuple(words[i : i + 5]) for i in range(n - 4)]
    upper, small = count(quality.UPPER), count(quality.LOWER)
    size = sum(map(len, lines))
    return [
        np.log1p(n),
        dark / n,
        count(quality.LETTER) / dark,
        count(quality.DIGIT) / dark,
        upper / max(upper + small, 1),
        count(quality.SYMBOL) / dark,
        count(quality.SHOUT) / dark,
        sum(quality.STOP[x[-1]] for x in lines) / len(lines),
        len(twice) / len(lines),
        sum(len(lines[k]) for k in twice) / max(size, 1),
        1 - again(words) / n,
        max(Counter(words).values()) / n,
        sum(not any(quality.LETTER[b] for b in w) for w in words) / n,
        np.log1p(size / len(lines)),
        count(quality.BAR) / dark,
        again(runs) / max(len(runs), 1),
        sum(len(w) <= 3 for w in words) / n,
        np.log1p(max(map(len, words))),
    ]


def test_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees, threshold = quality.train(docs, table(spark, sf_dir, "labels"))
    want = {}
    for r in docs.collect():
        x = np.array(statistics(r.text))
        p = 1 / (1 + np.exp(-walked(trees, x)))
        if x[0] > 0 and p >= threshold:
            want[r.doc_id] = p
    got = {r.doc_id: r.score for r in queries.QUERIES["op2_quality_rules"](spark, sf_dir).collect()}
    assert set(got) == set(want) and len(got) > 100
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def symbol(word):
    data = np.frombuffer(word, np.uint8)
    out = b""
    for k, n in enumerate((toxicity.SHORT, toxicity.STEM, None)):
        part = word.decode("utf-8", "surrogateescape")[:n].encode("utf-8", "surrogateescape")
        h = tb.span_hashes(np.frombuffer(part, np.uint8) if part else data[:0], np.array([0]), np.array([len(part)]))
        out += tb.mix(h + np.uint64(7 * k)).tobytes()
    return out


def toxic_windows(text):
    found = []
    for word in (text or "").encode().split():
        word = word.strip(b".,;:!?\"'()[]{}|*#$%&<>") or word[:1]
        chars = word.decode()
        unspaced = re.search("[฀-໿က-Ⴟក-៿　-￿]", chars)
        step = toxicity.PAIR if unspaced else toxicity.STEM if len(chars) > toxicity.LONG else toxicity.LONG
        found += [symbol(chars[i : i + step].encode()) for i in range(0, len(chars), step)]
    return [b"".join(found[i : i + toxicity.WINDOW]) for i in range(0, max(1, len(found) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)] if found else []


def test_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)

    def length(x, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))

    want = {}
    for r in docs.orderBy("doc_id").collect()[::4]:
        gain = [length(x, model.ordinary) - length(x, model.toxic + model.ordinary) for x in toxic_windows(r.text)]
        n = toxicity.BLOCK
        mean = sum(gain) / len(gain) if gain else 0.0
        densest = max((sum(gain[i : i + n]) / n for i in range(len(gain) - n + 1)), default=mean) if len(gain) > n else mean
        want[r.doc_id] = (len(gain), round(mean, 9), round(densest, 9), mean >= model.mean or densest >= model.block)
    got = {r.doc_id: (r.n_windows, round(r.gain, 9), round(r.densest_gain, 9), r.toxic) for r in toxicity.score(docs, model).collect()}
    assert {i: got[i] for i in want} == want
    assert {r.doc_id for r in queries.QUERIES["op3_toxicity"](spark, sf_dir).collect()} == {i for i, x in got.items() if x[3]}


def test_token_orc(spark, sf_dir):
    got = {r.doc_id: (r.n_tokens, r.tokens) for r in queries.QUERIES["op5_token_orc"](spark, sf_dir).collect()}
    encoding = tokens._encoding(tokens.TOKENIZER)
    want = {r.doc_id: encoding.encode_ordinary(r.text) for r in table(spark, sf_dir, "documents").collect()}
    assert got == {i: (len(t), t) for i, t in want.items()}


def test_html_wrappers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").collect()
    read, shapes = {}, defaultdict(set)
    for r in pages:
        host = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#:]*)", r.url or "")
        read[r.page_id] = (host[1].lower() if host else "", *wrappers._read(r.html or ""))
        shapes[read[r.page_id][0]].add(read[r.page_id][1])
    # Few shapes a host, so one task has them all.
    assert max(map(len, shapes.values())) <= 64
    made = {host: wrappers.aligned(list(s)) for host, s in shapes.items()}
    fields = {}
    for i, (host, shape, texts) in read.items():
        own = defaultdict(list)
        for k, t in zip(wrappers._slots_of(made[host], shape), texts):
            own[k] += t
        fields[i] = {k: "\n".join(v) for k, v in sorted(own.items())}
    fixed = {}
    for host in made:
        different = {tuple(fields[i].items()) for i in read if read[i][0] == host}
        held = defaultdict(list)
        for page in different:
            for k, t in page:
                held[k].append(t)
        fixed[host] = {k for k, v in held.items() if k >= 0 and len(v) > 1 and len(set(v)) == 1 and len(v) >= 0.5 * len(different)}
    want = {i: {k: t for k, t in f.items() if k not in fixed[read[i][0]]} for i, f in fields.items()}
    got = queries.QUERIES["op9_html_wrappers"](spark, sf_dir).collect()
    assert {r.page_id: {f.slot: f.text for f in r.fields} for r in got} == want
    assert {r.page_id: r.text for r in got} == {i: "\n".join(f.values()) for i, f in want.items()}
