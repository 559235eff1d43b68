from lattica.llm import scratch


def _there(path):
    fs, inner = scratch.open_fs(path)
    return fs.get_file_info(inner).type.name != "NotFound"


def test_only_unread_tables_are_removed(spark):
    with scratch.recorded() as made:
        a, b = scratch.save(spark.range(5), "a"), scratch.save(spark.range(7), "b")
    kept = scratch.drop_unread(made, a.where("id > 1"))
    assert kept == made[:1] and _there(made[0]) and not _there(made[1])
    assert a.count() == 5
    del b


def test_an_operators_other_tables_go(spark):
    paths = []

    @scratch.tidied
    def operator(df):
        with scratch.recorded() as made:
            one = scratch.save(df, "one")
            out = scratch.save(one.where("id > 1"), "two")
        paths.extend(made)
        return out

    assert operator(spark.range(5)).count() == 3
    assert not _there(paths[0]) and _there(paths[1])


def test_shared_folder_is_the_sessions(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch.new_path(spark, "x") != scratch.new_path(spark, "x")
    assert scratch.shared_dir(spark) == (before or scratch.shared_dir(spark))
