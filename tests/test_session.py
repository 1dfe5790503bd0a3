import os

from fathom.session import materialize, release, scratch


def folder(df):
    return df._fathom_path.removeprefix("file:")


def test_scratch_frees_all_but_what_is_kept(spark):
    with scratch() as keep:
        a = materialize(spark.range(5), "a")
        with scratch() as inner:
            b = inner(materialize(a.selectExpr("id * 2 as id"), "b"))
            c = materialize(b, "c")
        assert not os.path.exists(folder(c)) and os.path.exists(folder(b))
        d = keep(materialize(b, "d"))
    assert not os.path.exists(folder(a)) and not os.path.exists(folder(b))
    assert [r["id"] for r in d.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    release(d)
    assert not os.path.exists(folder(d))
    release(d)


def test_scratch_frees_after_an_error(spark):
    try:
        with scratch():
            a = materialize(spark.range(1), "a")
            raise ValueError
    except ValueError:
        pass
    assert not os.path.exists(folder(a))
