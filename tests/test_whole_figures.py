from tideloom.plans import records


def test_figures_of_pages_with_a_long_common_head(spark, tmp_path):
    head = "https://meta.wikimedia.org/wiki/"
    rows = [(1, 5.0, head + "A", "x"), (2, 5.0, head + "B", "longer"), (3, 5.0, head + "x" * 40, "a"), (4, 5.0, head + "x" * 50, "ab"), (5, None, head, "n")]
    spark.createDataFrame(rows, "fig_id long, figure_numeric double, source_url string, context string").write.parquet(f"{tmp_path}/wikimania_2017.parquet")
    assert sorted(r.fig_id for r in records.QUERIES["u08_longest_context"](spark, str(tmp_path)).collect()) == [1, 2, 4]
