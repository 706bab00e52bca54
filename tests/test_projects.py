from graphloom.sources import bundle, configs, projects


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_languages_services_and_catalogs(spark, tmp_path):
    paths = ["a/pom.xml", "a/X.java", "a/Y.java", "b/x.ts", "b/y.ts", "b/z.tsx", "c/readme", "d/app.csproj"]
    got = {r.lang: (r.files, r.manifests, r.main) for r in projects.languages(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"java": (2, 1, True), "typescript": (3, 0, False), "csharp": (0, 1, False)}
    files = [("x/META-INF/services/p.Codec", "# all\np.A\n p.B # second\n\np.A"), ("x/META-INF/other", "p.C")]
    assert {(r.service, r.provider, r.line) for r in projects.services(spark.createDataFrame(files, "path string, value string")).collect()} >= {("p.Codec", "p.A", 2), ("p.Codec", "p.B", 3)}
    toml = '[versions]\nk = "1.9"\n[libraries]\na-b = { module = "g:n", version.ref = "k" }\nc = "g:m:2"\n[bundles]\nall = ["a-b", "c"]'
    got = rows(projects.version_catalog(spark.createDataFrame([("f", toml), ("g", "= broken")], "path string, value string")))
    assert ("f", "libraries", "a.b", "g:n", "1.9") in got and ("f", "libraries", "c", "g:m", "2") in got and ("f", "bundles", "all", "a-b,c", None) in got
    assert [r[1] for r in got if r[0] == "g"] == ["skipped"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.py").write_text("x = 1")
    assert [r.lang for r in projects.languages(projects.listed(spark, str(tmp_path))).collect()] == ["python"]


def test_yaml_in_all_its_styles():
    text = """base: &base
  host: h
  ports: [80, 443]
prod:
  <<: *base
  host: p
copy: *base
map: {a: 1, b: {c: "x, y"}, d: []}
list:
  - name: n1
  - [q, r]
text: |
  one
    two

  three
folded: >-
  a
  b
after: !str 5 # note
--- # next
k: v
"""
    got = {(d, k): v for d, k, v in configs.flat_yaml(text)}
    assert got[0, "base.host"] == "h" and got[0, "base.ports.[1]"] == "443" and got[0, "prod.ports.[0]"] == "80" and got[0, "prod.host"] == "p"
    assert got[0, "copy.host"] == "h" and got[0, "map.b.c"] == "x, y" and got[0, "map.a"] == "1"
    assert got[0, "list.[0].name"] == "n1" and got[0, "list.[1].[1]"] == "r"
    assert got[0, "text"] == "one\n  two\n\nthree" and got[0, "folded"] == "a b" and got[0, "after"] == "5" and got[1, "k"] == "v"


def test_text_tables_and_short_ids(spark, tmp_path):
    runs = spark.createDataFrame([("b", "2"), ("a", None), ("a", None)], "key string, value string")
    bundle.write_tsv({"run": runs}, str(tmp_path))
    text = sorted(x for f in (tmp_path / "run").glob("part-*") for x in f.read_text().splitlines())
    assert sorted(set(text)) == ["a\t", "b\t2", "key\tvalue"]
    ids = spark.createDataFrame([("M:" + "0" * 16 + "a",), ("M:" + "0" * 16 + "b",), ("M:" + "1" * 20,)], "id string")
    assert rows(bundle.short_uids(ids, "id", 2)) == [("M:0000000000000000a",), ("M:0000000000000000b",), ("M:1111111111111111",)]
