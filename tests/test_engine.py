import subprocess

import pytest

from quarry.engine import Engine


def git(repo, *args):
    subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", repo, *args], check=True, capture_output=True)


def test_index_sync_and_search(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    git(repo, "init", "-q")
    (repo / "src/cart.rs").write_text("/// Checks a cart.\npub fn validate_cart() -> bool {\n    true\n}\npub struct Cart;\n")
    (repo / "README.md").write_text("# Shop\ncheckout and payment notes\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "initial\n\nadds the cart")
    (repo / "src/secret.rs").write_text("fn hidden() {}\n")
    e = Engine(spark, str(tmp_path / "w"), str(repo))
    first = e.index_all()
    assert first["commit"] == 1 and (first["code"]["scanned"], first["code"]["changed"]) == (1, 1) and first["document"]["changed"] == 1
    again = e.index_all()
    assert again["commit"] == 0 and again["code"]["changed"] == 0 and again["document"]["deleted"] == 0
    assert [r.identifier for r in e.search_text("validate OR cart", "code").collect()][:1] != []
    assert not e.search_text("hidden", "code").collect()
    assert e.search_all("cart OR payment").count() >= 3
    (repo / "src/cart.rs").write_text("pub fn check_inventory() {}\n")
    assert e.index_code()["changed"] == 1
    assert [r.identifier for r in e.search_hybrid("check_inventory", "code").collect()] == ["src/cart.rs::check_inventory"]
    git(repo, "rm", "-q", "--cached", "README.md")
    git(repo, "commit", "-qm", "drop")
    assert e.index_documents()["deleted"] == 1
    assert e.items().where("source_type = 'document'").count() == 0


def shop(tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    (repo / "lib.rs").write_text("pub fn pay() {}\n")
    (repo / "notes.md").write_text("# Notes\npay at the till\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "pay first\ntwice in one paragraph\n\nbody")
    return repo


def broken(texts):
    if texts != ["dimension"]:
        raise RuntimeError("no model")
    return [[1.0, 2.0]]


def test_generations_settings_and_records(spark, tmp_path):
    repo = shop(tmp_path)
    e = Engine(spark, str(tmp_path / "w"), str(repo), encoder=None)
    assert e.get("theme") is None and e.search_text("pay", None).collect() == []
    e.set("theme", "dark")
    e.index_all()
    assert e.get("theme") == "dark" and e.meta()["sources"]["code"]["generations"] == [1]
    commit = e.items("commit").first()
    assert commit.text == "pay first\n\ntwice in one paragraph\n\nbody"
    assert e.search_similar("pay", "code").collect() == []
    assert {r.match_type for r in e.search_hybrid("pay", "code").collect()} == {"fts"}
    assert {r.source_type for r in e.search_hybrid("pay", "commit", compat=True).collect()} == {"commit", "code", "document"}
    found = e.records(e.search_all("pay"), "code").first()
    assert (found.symbol_kind, found.file_path, found.line_start, found.match_type) == ("function", "lib.rs", 1, "hybrid")
    assert len(e.records(e.search_all("pay"), "commit").first().short_hash) >= 7
    for i in range(3):
        (repo / "lib.rs").write_text(f"pub fn pay{i}() {{}}\n")
        e.index_code()
    assert e.meta()["sources"]["code"]["generations"] == [4, 3] and e.meta()["sources"]["document"]["generations"] == [1]
    assert sorted(p.name for p in (tmp_path / "w").glob("*/code/gen=*")) == ["gen=3", "gen=4"]
    assert [r.identifier for r in e.search_text("pay2", "code").collect()] == ["lib.rs::pay2"] and not e.search_text("pay0", "code").collect()
    assert e.reindex("code")["items"] == 1 and e.reindex("commit") == 1 and e.reindex("document")["items"] == 1


def test_unreadable_files_keep_their_items(spark, tmp_path):
    repo = shop(tmp_path)
    e = Engine(spark, str(tmp_path / "w"), str(repo), encoder=None)
    e.index_code()
    (repo / "lib.rs").write_bytes(b"\xff\xfe\xff")
    (repo / "more.rs").write_text("fn more() {}\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "more")
    report = e.index_code()
    assert list(report["errors"]) == ["lib.rs"] and (report["changed"], report["deleted"]) == (1, 0)
    assert {r.identifier for r in e.items("code").collect()} == {"lib.rs::pay", "more.rs::more"}


def test_documents_with_an_old_time_are_not_opened(spark, tmp_path, monkeypatch):
    repo = shop(tmp_path)
    e = Engine(spark, str(tmp_path / "w"), str(repo), encoder=None)
    assert e.index_documents()["changed"] == 1
    from quarry.sources import git as source

    kept = source.tracked(spark, str(repo), "document", {"notes.md": int((repo / "notes.md").stat().st_mtime)}).first()
    assert kept.content is None and kept.error is None
    assert e.index_documents()["changed"] == 0
    hashed = e.registry("document").first().content_hash
    (repo / "other.md").write_text("other\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "other")
    assert e.index_documents()["changed"] == 1
    assert e.registry("document").where("file_path = 'notes.md'").first().content_hash == hashed


def test_encoders(spark, tmp_path):
    repo = shop(tmp_path)
    w = str(tmp_path / "w")

    def flat(texts):  # local, so that it is pickled whole
        return [[1.0, float(len(t or ""))] for t in texts]

    e = Engine(spark, w, str(repo))
    e.index_code()
    assert len(e.items("code").first().embedding) == 256
    other = Engine(spark, w, str(repo), encoder=flat)
    assert other.search_similar("pay", "code").collect() == []  # vectors of another length aren't compared
    (repo / "b.rs").write_text("fn b() {}\n")
    git(repo, "add", ".")
    other.index_code()
    git(repo, "commit", "-qm", "b")
    other.index_code()
    assert {len(r.embedding) for r in other.items("code").collect()} == {2} and other.meta()["sources"]["code"]["dim"] == 2
    assert len(other.search_similar("pay", "code").collect()) == 2
    with pytest.warns(UserWarning, match="full text only"):
        assert {r.match_type for r in Engine(spark, w, str(repo), encoder=broken).search_hybrid("pay", "code").collect()} == {"fts"}
    with pytest.warns(UserWarning, match="full text only"):
        assert Engine(spark, w, str(repo), encoder=lambda texts: 1 / 0).encoder is None


def test_one_failing_source_leaves_the_others(spark, tmp_path, monkeypatch):
    repo = shop(tmp_path)
    e = Engine(spark, str(tmp_path / "w"), str(repo), encoder=None)
    monkeypatch.setattr(e, "index_code", lambda: 1 / 0)
    found = e.index_all()
    assert "error" in found["code"] and found["commit"] == 1 and found["document"]["changed"] == 1
