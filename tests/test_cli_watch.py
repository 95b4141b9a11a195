import pytest
from test_engine import git

from quarry import cli
from quarry.streaming import watch


def test_command_line(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    git(repo, "init", "-q")
    (repo / "src/cart.rs").write_text("pub fn validate_cart() -> bool {\n    true\n}\n")
    (repo / "README.md").write_text("# Shop\ncheckout notes\n")
    git(repo, "add", ".")
    git(repo, "commit", "-qm", "initial cart")
    base = ["--repo", str(repo), "--warehouse", str(tmp_path / "w"), "--no-embed"]
    assert cli.main([*base, "index"], spark) == 0
    assert "commit: 1" in capsys.readouterr().out
    assert cli.main([*base, "search", "validate_cart", "--source", "code", "--mode", "text"], spark) == 0
    assert "fn       src/cart.rs:1       validate_cart — pub fn validate_cart() -> bool [Code]" in capsys.readouterr().out
    assert cli.main([*base, "search", "checkout OR cart"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) >= 2 and [x.split()[0] for x in out] == [str(i) for i in range(1, len(out) + 1)]
    assert cli.main([*base, "log", "--count", "1"], spark) == 0
    assert "initial cart" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([*base, "index", "--again"], spark)
    assert cli.main(["--repo", str(tmp_path), "log"], spark) == 1


def test_watch_takes_what_is_new(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.md").write_text("# A\nfirst\n")
    (folder / "bad.md").write_bytes(b"\xff\xfe")
    watch.watch(spark, str(folder), table, state).awaitTermination(60)
    assert [r.identifier.endswith("/a.md") for r in watch.items(spark, table).collect()] == [True]
    (folder / "b.txt").write_text("second\n")
    watch.watch(spark, str(folder), table, state).awaitTermination(60)
    assert watch.items(spark, table).count() == 2
    watch.watch(spark, str(folder), table, state).awaitTermination(60)
    assert watch.items(spark, table).count() == 2
