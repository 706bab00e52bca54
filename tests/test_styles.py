from pyspark.sql import functions as F

from graphloom.operators import styles, web

PAGE = """<html><body><nav id="n"><a href="#top">up</a><a href="#gone">x</a></nav><h1>A</h1><h2>B</h2><h3>C</h3><h2>D</h2>
<form id="f"><label>Name <input name="q"></label><button onclick="go()" style="color: red; --x: 1">ok</button></form>
<label for="z">Z</label><input id="z" form="f" data-kind="Main"><p id="top" class="a b">t</p><p id="n"></p></body></html>"""


def tree_of(spark, html=PAGE):
    return web.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_selectors(spark):
    tree = tree_of(spark)
    tags = {r.element: r.tag for r in tree.collect()}

    def hit(selector):
        return sorted((tags[r.element], r.status) for r in web.select_list(tree, selector).collect())

    assert hit("p:not(.a)") == [("p", 3)]
    assert hit("p.a, h1") == [("h1", 3), ("p", 3)]
    assert hit(":is(h1, h3)") == [("h1", 3), ("h3", 3)]
    assert hit("form:has(button)") == [("form", 3)]
    assert hit("body:has(> button)") == []
    assert hit("form:has(button:hover) > button") == [("button", 1 + 1)]
    assert hit("[data-kind='main' i]") == [("input", 3)]
    assert hit("[data-kind='main']") == []
    assert hit("p:last-child") == [("p", 3)] and hit("p:empty") == [("p", 3)]
    assert hit("h2:nth-of-type(2)") == [("h2", 3)]
    assert hit("h1 ~ h2 + form") == [("form", 3)]
    assert hit("a:not(:hover)") == [("a", 2), ("a", 2)]
    assert web.chain("a > b  c") == [("", "a"), (">", "b"), (" ", "c")]
    assert web.selector_list("a:is(b, c), d[x=',']") == ["a:is(b, c)", "d[x=',']"]


def test_page_questions(spark):
    tree = tree_of(spark)
    at = {r.tag + (r.id or ""): r.element for r in tree.collect()}
    assert rows(styles.duplicate_ids(tree)) == [(1, "n", 2)]
    assert [(r.id, r.target) for r in styles.fragment_targets(tree).orderBy("element").collect()] == [("top", at["ptop"]), ("gone", None)]
    assert [(r.event, r.code) for r in styles.handlers(tree).collect()] == [("click", "go()")]
    assert [tuple(r)[2:] for r in styles.inline_styles(tree).collect()] == [("color", "red"), ("--x", "1")]
    got = {r.title: (r.level, r.parent) for r in styles.outline(tree).collect()}
    assert got["A"] == (1, None) and got["C"][1] is not None and got["D"] == (2, got["B"][1])
    form = {r.control: (r.form, r.label is not None) for r in styles.controls(tree).collect()}
    assert form[at["inputz"]] == (at["formf"], True) and form[at["button"]] == (at["formf"], False) and form[at["input"]] == (at["formf"], True)


def test_values(spark):
    df = spark.createDataFrame([("#ABC",), ("rgb(1, 2, 255)",), ("Red",)], "c string")
    assert [r[0] for r in df.select(styles.colour(F.col("c"))).collect()] == ["#aabbcc", "#0102ff", "red"]
    df = spark.createDataFrame([("(min-width: 40em) and (max-width: 900px)",), ("print",)], "q string")
    assert [tuple(r) for r in df.select(styles.media_bound(F.col("q"), "min"), styles.media_bound(F.col("q"), "max")).collect()] == [(640.0, 900.0), (None, None)]
    wide = styles.expanded(spark.createDataFrame([("border", "1px"), ("top", "0")], "property string, value string"))
    assert {"border", "border-color", "border-top-color", "top"} <= {r.property for r in wide.collect()}
    sheet = spark.createDataFrame([(":root", "--c", "red"), ("a", "color", "var(--c, blue)")], "selector string, property string, value string")
    defined, used = styles.custom_properties(sheet)
    assert rows(defined) == [(":root", "--c", "red")] and rows(used) == [("a", "color", "--c")]


def test_cascade_loads_and_nesting(spark):
    c = spark.createDataFrame([(1, 1, "color", False, False, 100, 1, 3, "x"), (1, 1, "color", False, False, 100, 2, 2, "y"), (1, 1, "color", True, False, 1, 0, 3, "z")], "page_id long, element int, property string, important boolean, inline boolean, specificity int, position int, status int, name string")
    assert [(r.name, r.place, r.sure) for r in styles.cascade(c).orderBy("place").collect()] == [("z", 1, True), ("y", 2, True), ("x", 3, True)]
    links = spark.createDataFrame([(1, "/a.css", 0), (1, "http://o/b.css", 1), (2, "/gone.css", 0)], "page_id long, href string, place int")
    sheets = spark.createDataFrame([("/a.css",), ("/i.css",), ("/lone.css",)], "sheet string")
    loaded, unknown = styles.loads(links, sheets, spark.createDataFrame([("/a.css", "/i.css"), ("/i.css", "/a.css")], "sheet string, imported string"))
    assert rows(loaded) == [(1, "/a.css", 0), (1, "/i.css", 0)]
    assert rows(unknown) == [(1, "http://o/b.css", "external"), (2, "/gone.css", "no such file")]
    assert rows(styles.never_loaded(sheets, loaded)) == [("/lone.css",)]
    rules = spark.createDataFrame([(1, None, ".a"), (2, 1, "&:hover"), (3, 2, "b")], "rule int, parent int, selector string")
    assert rows(styles.nested(rules)) == [(1, ".a"), (2, ".a:hover"), (3, ".a:hover b")]
    rules = spark.createDataFrame([(1, None, "a, b"), (2, 1, "c, &:is(x, y)"), *[(k, k - 1, "& > i") for k in range(3, 30)]], "rule int, parent int, selector string")
    got = dict(rows(styles.nested(rules)))
    assert got[2] == ":is(a, b) c, :is(a, b):is(x, y)" and got[29].count("> i") == 27  # however deep
    links = spark.createDataFrame([(1, "/b.css", 2), (1, "/a.css", 0)], "page_id long, href string, place int")
    sheets = spark.createDataFrame([("/a.css",), ("/b.css",), ("/i.css",)], "sheet string")
    loaded, _ = styles.loads(links, sheets, spark.createDataFrame([("/a.css", "/i.css"), ("/b.css", "/i.css"), ("/i.css", "/b.css")], "sheet string, imported string"))
    assert rows(loaded) == [(1, "/a.css", 0), (1, "/b.css", 0), (1, "/i.css", 0)]  # the first link that leads there
