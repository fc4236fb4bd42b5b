import html
import re

from pyspark.sql import functions as F

from quern.llm import wrappers as w
from quern.llm.shared import Scratch


def page(title, items, note=None, ad=True):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>x='<p>'</script></head><body><div class=top>My shop</div><h1>{title}</h1>" + "<ul>" + "".join(f"<li><b>{a}</b> {b}" for a, b in items) + "</ul>" + (f"<p class='note'>{note}<br>more</p>" if note else "") + ("<i>ad</i>" if ad else "") + "<!-- x --></body></html>"


def words(h):
    """All texts of a page in order, by another way."""
    h = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!.*?>", "", h)
    return sorted(" ".join(re.sub(r"<[^>]*>", " ", h).split()).split())


def test_wrapper_of_a_template():
    pages = [page("A", [("x", "1"), ("y", "2")]), page("B", [("z", "3")], note="hey"), page("C", [("q", "4")] * 5, ad=False)]
    out = w.bare(w.parse(pages[0]))
    for p in pages[1:]:
        out = w.align(out, w.bare(w.parse(p)))
    assert w.loads(w.dumps(out)) == out
    assert w.expression(out) == "<html><head><title>#0</title></head><body><div.top>#1</div.top><h1>#2</h1><ul>(<li><b>#3</b>#4</li>)+</ul>(<p.note>#5<br></br>#6</p.note>)?(<i>#7</i>)?</body></html>"


def test_longer_repeats_become_groups():
    assert w.expression(w.bare(w.parse("<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"))) == "<dl>(<dt>#0</dt><dd>#1</dd>)+</dl>"


def test_extraction_by_hand(spark):
    rows = [(1, "http://a.b/x", page("A", [("x", "1"), ("y", "2")])), (2, "https://A.b:80/y?q", page("B", [("z", "3")], note="hey")), (3, "http://a.b", page("C &amp; D", [("q", "4"), ("r", "5")], ad=False)), (4, "http://other/", "<p>one</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.text) for r in w.extract(df, group=2).collect()}
    assert got == {1: ("a.b", "A\nA\nx\ny\n1\n2"), 2: ("a.b", "B\nB\nz\n3\nhey\nmore"), 3: ("a.b", "C & D\nC & D\nq\nr\n4\n5"), 4: ("other", "one")}


def test_no_text_is_lost_and_grouping_keeps_one_wrapper_a_host(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    shapes = spark.createDataFrame(list({("one.host", w._read(r.html)[0]) for r in pages}), "host string, shape string")
    found = w.infer(shapes, Scratch(spark, "w"), group=8).collect()
    assert len(found) == 1
    wrapper = w.loads(found[0].wrapper)
    n_slots = w.expression(wrapper).count("#")
    lost = 0
    for r in pages:
        shape, texts = w._read(r.html)
        slots = w.place(wrapper, w.loads(shape))
        assert len(slots) == len(texts) and max(slots, default=0) < n_slots
        assert [" ".join(t.split()) for ts in texts for t in ts] == [t for ts in texts for t in ts]
        assert sorted(" ".join(t for ts in texts for t in ts).split()) == sorted(html.unescape(" ".join(words(r.html))).split())
        lost += sum(k < 0 for k in slots)
    # A text has no slot only where a page can be read in two ways.
    assert lost == 0


def test_repeats_are_found_from_a_mismatch():
    one, three = "<dl><dt>a</dt><dd>b</dd></dl>", "<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"
    for pages in ([one, three], [three, one], [one, one, three]):
        assert inferred(pages) == "<dl>(<dt>#0</dt><dd>#1</dd>)+</dl>"
    plain, sale = "<h3>a</h3><p>b</p>", "<h3>a</h3><i>s</i><p>b</p>"
    want = "(<h3>#0</h3>(<i>#1</i>)?<p>#2</p>)+"
    assert inferred([plain, plain + sale + plain]) == inferred([plain, sale + plain]) == inferred([plain, sale, plain * 3]) == want
    assert inferred(["<h1>t</h1>" + plain + "<hr>", "<h1>t</h1>" + sale + plain + "<hr>"]) == f"<h1>#0</h1>{want.replace('2', '3').replace('1', '2').replace('#0', '#1')}<hr></hr>"
    # Repeats of any length, inside each other, and what only follows once.
    assert inferred(["".join(f"<{t}>x</{t}>" for t in "abius") * 3]) == "(<a>#0</a><b>#1</b><i>#2</i><u>#3</u><s>#4</s>)+"
    assert inferred(["<b>x</b>" + plain + "<b>x</b>" + plain * 2]) == "(<b>#0</b>(<h3>#1</h3><p>#2</p>)+)+"
    assert inferred(["<b>x</b><i>y</i>", "<b>x</b>"]) == "<b>#0</b>(<i>#1</i>)?"


def inferred(pages):
    return w.expression(w.loads(w.aligned([w._read(p)[0] for p in pages])))


def pattern(items):
    """A wrapper as an expression over the letters of its tags."""
    out = ""
    for name, count, inside in items:
        out += f"(?:{name}\\[{pattern(inside)}\\]){count}" if name and name != "#" else f"(?:{pattern(inside) if not name else '#'}){count}"
    return out


def letters(items):
    return "".join("#" if n == "#" else f"{n}[{letters(inside)}]" for n, _, inside in items)


def unfolded(rng, depth):
    out = []
    for _ in range(rng.randrange(7)):
        x = rng.choice("pqrs" if depth else "pq#")
        if x != "#" or not out or out[-1][0] != "#":
            out.append([x, "", [] if x == "#" else unfolded(rng, depth - 1) if depth else []])
    return out


def test_wrappers_accept_each_page_they_come_from():
    import copy
    import random

    rng = random.Random(1)
    for depth, rounds in ((0, 3000), (1, 1500), (2, 200)):
        for _ in range(rounds):
            pages = [unfolded(rng, depth) for _ in range(rng.randrange(1, 4))]
            wrapper = w.fold(copy.deepcopy(pages[0]))
            for p in pages[1:]:
                wrapper = w.align(wrapper, w.fold(copy.deepcopy(p)))
            for p in pages:
                assert re.fullmatch(pattern(wrapper), letters(p)), (pages, pattern(wrapper))


def test_alignment_of_small_pages_leaves_as_few_items_optional_as_any():
    """Lists without repeats: what isn't in the longest common list is optional, and every shorter wrapper would miss a page."""
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([[x, "", []] for x in rng.sample("pqrstu", rng.randrange(6))] for _ in range(2))
        got = w.align(a, b)
        ka, kb = "".join(i[0] for i in a), "".join(i[0] for i in b)
        both = max(len(x) for n in range(len(ka) + 1) for x in itertools.combinations(ka, n) if re.search(".*".join(x) if x else "", kb))
        repeated = sum(i[1] in ("+", "*") or not i[0] for i in got)
        if not repeated:
            assert sum(i[1] == "" for i in got) == both and len(got) == len(a) + len(b) - both


def brute(a, b):
    best = {}

    def go(i, k):
        if i == len(a) or k == len(b):
            return 0
        if (i, k) not in best:
            best[i, k] = go(i + 1, k + 1) + 1 if a[i] == b[k] else max(go(i + 1, k), go(i, k + 1))
        return best[i, k]

    return go(0, 0)


def test_alignment_is_a_longest_common_subsequence():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("pqrs") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = w.common(a, b)
        assert len(pairs) == brute(a, b) and all(a[x] == b[y] for x, y in pairs)
        assert pairs == sorted(pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    for n, m in ((300, 300), (2100, 2100), (40, 5000), (3000, 7)):
        a, b = ([rng.randrange(50) for _ in range(k)] for k in (n, m))
        pairs = w.common(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        row = [0] * (m + 1)
        for x in a:
            last = 0
            for k in range(m):
                last, row[k + 1] = row[k + 1], last + 1 if x == b[k] else max(row[k], row[k + 1])
        assert len(pairs) == row[-1]


def test_any_depth():
    deep = "<div>" * 30000 + "deep"
    shape, texts = w._read(deep)
    assert texts == [["deep"]] and shape.count("div") == 30000
    wrapper = w.aligned([shape, w._read("<div>" * 20000 + "other")[0]])
    assert wrapper.count("?") == 2 and w._slots_of(wrapper, shape) == [0]
    assert [t for ts in w._read("<b>" * 100 + "a</i>" + "</b>" * 50 + "b")[1] for t in ts] == ["a", "b"]


def test_template_texts_are_on_a_share_of_the_pages(spark):
    both = "<p>{}</p>"
    rows = [(i, "http://h/", both.format(f"text {i}") + ("<i>only on two copies</i>" if i < 2 else "") + "<b>shop</b>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.extract(df, group=4).collect()}
    assert got == {i: f"text {i}" + ("\nonly on two copies" if i < 2 else "") for i in range(20)}


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://h/", "<div>" * 5000 + "deep"), (4, "http://h/", "<p>" + "word " * 300000), (4, "http://h/", "<p>" + "word " * 300000), (5, "http://k/", "a < b <b>c"), (None, "http://k/", "<b>x</b"), (6, "http://k/", "<!-- never closed <p>t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("fields", F.lit(1))
    got = sorted(((str(r.page_id), r.host, len(r.text)) for r in w.extract(df).collect()))
    assert got == [("1", "", 0), ("2", "", 0), ("3", "h", 4), ("4", "h", 1499999), ("4", "h", 1499999), ("5", "k", 7), ("6", "k", 0), ("None", "k", 1)]
    assert w.extract(df.where("false")).collect() == []
