"""Source trees as a data source: gates, pruned folders, pushed filters."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from veritide.sources import trees
from veritide.sources.files import IGNORED

FILES = {
    "a.py": "x = 1\n", "README": "read me", "src/b.py": "y = é", "src/c.js": "z" * 5000, "src/deep/er/d.PY": "", "src/.hidden.py": "h", "lib/e.tar.gz": "e", "node_modules/x/y.js": "no", "src/build/z.py": "no", "lib/f.pyc": "no",
}
KEPT = {p for p in FILES if not any(x in p for x in ("node_modules", "build", ".pyc"))}


@pytest.fixture
def root(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe end")
    return str(tmp_path)


def load(spark, root, **options):
    trees.register(spark)
    return spark.read.format("source_tree").options(**options).load(root)


@pytest.mark.parametrize("folders", [1, 2, 64])
def test_all_files_once(spark, root, folders):
    rows = {r.path: r for r in load(spark, root, folders=folders).collect()}
    assert set(rows) == KEPT | {"bad.txt"}
    for path in KEPT:
        assert (rows[path].content, rows[path].hash, rows[path].size) == (FILES[path], hashlib.sha256(FILES[path].encode()).hexdigest(), len(FILES[path].encode()))
    assert rows["bad.txt"].content == "ok  end" and rows["src/deep/er/d.PY"].ext == ".py" and rows["src/.hidden.py"].ext == ".py" and rows["lib/e.tar.gz"].ext == ".gz" and rows["README"].ext == ""


def test_filters_are_pushed(spark, root, capsys):
    rows = load(spark, root).filter((F.col("ext") == ".py") & F.col("path").startswith("src/") & (F.col("size") < 100) & (F.length("content") >= 0))
    assert {r.path for r in rows.collect()} == {"src/b.py", "src/deep/er/d.PY", "src/.hidden.py"}
    rows.explain("formatted")
    assert "PushedFilters: [EqualTo(ext,.py), StringStartsWith(path,src/), LessThan(size,100)]" in capsys.readouterr().out
    assert {r.path for r in load(spark, root, content="false").filter("ext in ('.js', '.gz')").collect()} == {"src/c.js", "lib/e.tar.gz"}
    assert load(spark, root, most=10, ignored="*.py\nsrc").filter("content is not null").select("path").count() == 5


class Counted(trees.TreeReader):
    """Notes every folder that is listed and every file that is opened."""

    def __init__(self, *args):
        super().__init__(*args)
        self.listed, self.read_files = [], []

    def entries(self, files, base, folder):
        self.listed.append(folder)
        return super().entries(files, base, folder)

    def opened(self, files, path):
        self.read_files.append(path)
        return super().opened(files, path)


@pytest.mark.parametrize("folders", [1, 64])
def test_what_is_left_out_is_never_listed_or_opened(root, folders):
    reader = Counted({"path": root, "folders": str(folders)}, IGNORED)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0] for r in rows} == KEPT | {"bad.txt"} and len(rows) == len(reader.read_files)
    assert set(reader.listed) == {"", "src", "lib", "src/deep", "src/deep/er"}
    reader = Counted({"path": root, "folders": str(folders)}, IGNORED)
    left = list(reader.pushFilters([trees.StringStartsWith(("path",), "src/d"), trees.EqualTo(("ext",), ".py"), trees.EqualTo(("hash",), "x")]))
    assert [f.attribute for f in left] == [("hash",)]
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"src/deep/er/d.PY"}
    assert set(reader.listed) == {"", "src", "src/deep", "src/deep/er"} and len(reader.read_files) == 1


def test_an_empty_or_missing_folder_has_no_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert load(spark, str(tmp_path / "x")).count() == 0 and load(spark, str(tmp_path / "none")).count() == 0
