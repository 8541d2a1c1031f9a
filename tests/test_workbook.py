from corpusloom.sources.workbook import read_workbook, write_workbook


def test_workbook_round_trip(spark, tmp_path):
    wl = spark.createDataFrame([("7", "A & <b>", "2020.0", "ACM", "x"), (None, " ", None, None, None), ("9", "bad year", "soon", None, None)], "id string, Title string, Ano string, Library string, Keywords string").coalesce(1)
    gl = spark.createDataFrame([("G1", "web", "text", "found")], "Global_ID string, title string, Summary string, Detected_Source string")
    path = str(tmp_path / "book.xlsx")
    write_workbook({"White lit": wl, "GL": gl, "notes": gl}, path)
    a, b, c = read_workbook(spark, path).orderBy("ordinal").collect()
    assert (a.id, a.title, a.publication_year, a.source_type, a.abstract, a.metadata) == ("7", "A & <b>", 2020, "WL", "", {"Library": "ACM", "Keywords": "x", "Sheet": "White lit"})
    assert (b.id, b.title, b.publication_year, b.metadata) == ("WL-2", "Untitled WL-2", None, {"Sheet": "White lit"})
    assert (c.id, c.abstract, c.source_type, c.metadata) == ("G1", "text", "GL", {"Detected_Source": "found", "Sheet": "GL"})
