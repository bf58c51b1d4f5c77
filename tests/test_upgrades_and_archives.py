"""Migrations that stop and go on, and attachments in archives in archives."""

import gzip
import io
import json
import tarfile
import zipfile
from email.message import EmailMessage

import pytest

from loregrid import migrations, store
from loregrid.engine import Engine
from loregrid.sources import mail
from loregrid.sources.attachments import Budget, expanded


@pytest.fixture
def first(spark, tmp_path):
    """A workspace as the first version wrote it."""
    docs = spark.createDataFrame([("a", "markdown", "/a.md", "A", "alpha beta", "alpha", {}, "h1", None, None), ("b", "markdown", "/b.md", "B", "beta", "beta", {}, "h2", None, None)], store.SCHEMAS["documents"])
    tags = spark.createDataFrame([("a", "mine", True)], store.SCHEMAS["document_tags"])
    for name, rows in (("documents", docs), ("document_tags", tags)):
        rows.write.parquet(str(tmp_path / name / "v-1"))
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "tables": {"documents": "documents/v-1", "document_tags": "document_tags/v-1"}, "model": "m", "dim": 2}))
    return str(tmp_path)


def test_a_first_version_is_upgraded(spark, first):
    e = Engine(spark, first, buckets=2)
    with pytest.raises(ValueError, match="upgraded"):
        e.documents()
    assert migrations.version_of(e.store) == 1 and migrations.migrate(e.store) == [2] and migrations.migrate(e.store) == []
    assert {r.id: r.tags for r in e.documents().collect()} == {"a": ["mine"], "b": []}
    assert [r.id for r in e.search("alpha").collect()] == ["a"] and e.store.manifest()["lexicon"] == {"documents": 2, "terms": 3}
    assert (e.store.manifest()["model"], migrations.version_of(e.store)) == ("m", 2)


def test_a_failed_upgrade_goes_on(spark, first, monkeypatch):
    s, replaced = store.Store(spark, first, buckets=2), []
    replace = store.Change.replace

    def counted(self, table, *rest):
        replaced.append(table)
        if len(replaced) == 2:
            raise OSError("gone")
        replace(self, table, *rest)

    monkeypatch.setattr(store.Change, "replace", counted)
    with pytest.raises(OSError):
        migrations.migrate(s)
    with pytest.raises(ValueError, match="upgraded"):
        s.read("documents")
    assert migrations.version_of(s) == 1 and migrations.migrate(s) == [2]
    assert replaced == ["document_tags", "documents", "documents", "lengths"]  # what was done is not done again
    assert s.read("documents").count() == 2 and s.read("document_tags").count() == 1


def test_a_newer_version_is_refused(spark, first):
    s = store.Store(spark, first)
    migrations.migrate(s)
    with s.change() as c:
        c.facts(version=store.VERSION + 1)
    with pytest.raises(ValueError, match="version"):
        migrations.migrate(s)


# --- archives ---


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def tarred(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name.replace("__", "."))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_in_archives():
    inner = gzip.compress(tarred(deep__txt=b"deep"))
    got, failed = expanded("all.zip", zipped(a__txt=b"one", more__tgz=inner, b__docx=b"PK\x03\x04 not opened"), Budget(depth=4))
    assert dict(got) == {"all.zip/a.txt": b"one", "all.zip/b.docx": b"PK\x03\x04 not opened", "all.zip/more.tgz/more.tar/deep.txt": b"deep"} and failed == []
    assert expanded("x.txt", b"text", Budget()) == ([("x.txt", b"text")], [])


def test_budgets():
    got, failed = expanded("all.zip", zipped(a__txt=b"one", in__zip=zipped(b__zip=zipped(c__txt=b"c"))), Budget(depth=2))
    assert [n for n, _ in got] == ["all.zip/a.txt"] and failed == ["all.zip/in.zip/b.zip: archives lie more than 2 deep"]
    got, failed = expanded("bomb.zip", zipped(a__txt=b"a", bomb__txt=b"0" * 5_000_000, c__txt=b"c"), Budget(total=100_000, each=1000))
    assert [n for n, _ in got] == ["bomb.zip/a.txt", "bomb.zip/c.txt"] and failed == ["bomb.zip/bomb.txt: larger than 1000 bytes"]
    got, failed = expanded("many.zip", zipped(**{f"f{i}__txt": b"x" for i in range(9)}), Budget(entries=4))
    assert len(got) == 4 and failed == ["many.zip: too many entries"]
    got, failed = expanded("big.zip", zipped(**{f"f{i}__txt": b"x" * 900 for i in range(9)}), Budget(total=2000, each=1000))
    assert len(got) == 2 and failed == ["big.zip: f2.txt exceeds the byte budget"]
    assert expanded("bad.zip", b"PK\x03\x04 cut", Budget())[1][0].startswith("bad.zip: ")


def test_mail_with_archives_and_one_budget():
    m = EmailMessage()
    m["Subject"], m["From"] = "Files", "a@b.example"
    m.set_content("see the files")
    for name in ("one.zip", "two.zip"):
        m.add_attachment(zipped(note__txt=b"write to joe@mail.example", sub__zip=zipped(deep__md=b"deep note")), maintype="application", subtype="zip", filename=name)
    found = mail.parse("m.eml", m.as_bytes())
    assert [p.metadata["attachment"] for p in found[1:]] == ["one.zip/note.txt", "one.zip/sub.zip/deep.md", "two.zip/note.txt", "two.zip/sub.zip/deep.md"]
    assert "j***@mail.example" in found[1].content and "attachment_failures" not in found[0].metadata
    found = mail.parse("m.eml", m.as_bytes(), budget=Budget(entries=4))
    assert len(found) == 1 + 3 and "two.zip: too many entries" in found[0].metadata["attachment_failures"]
