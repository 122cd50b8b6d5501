"""Walks of nested documents."""

from basketlab.functions.leaves import leaves


def walk(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")
    else:
        text = str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else None
        yield path, text, float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


DOCS = [
    {"k": 1, "a": {"n": 1.5, "flag": True, "none": None, "deep": [{"x": [1, 2]}, {"x": []}]}, "m": {"t 1": 0.25, "u": None}, "s": ["", "b"]},
    {"k": 2, "a": None, "m": {}, "s": []},
    {"k": 3, "a": {"n": -1e-9, "flag": False, "none": "", "deep": None}, "m": None, "s": None},
]
SCHEMA = "k int, a struct<n:double,flag:boolean,none:string,deep:array<struct<x:array<long>>>>, m map<string,double>, s array<string>"


def test_every_leaf_by_path(spark):
    found = leaves(spark.createDataFrame(DOCS, SCHEMA), "k").collect()
    expected = [(d["k"], *leaf) for d in DOCS for leaf in walk({n: v for n, v in d.items() if n != "k"})]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_no_documents(spark):
    assert leaves(spark.createDataFrame([], SCHEMA), "k").count() == 0
