import pytest

from lodestream import __main__, config


def test_precedence_and_provenance():
    s = config.settings({"step_s": 3}, {"LODESTREAM_STEP_S": "2", "LODESTREAM_IDLE_S": "9"}, "idle_s = 4\nnotices = 5\n", "a.toml")
    assert s["step_s"] == config.Setting(3.0, "flag") and s["idle_s"] == config.Setting(9.0, "environment LODESTREAM_IDLE_S")
    assert s["notices"] == config.Setting(5, "a.toml") and s["summary_s"] == config.Setting(60.0, "default")
    for bad in ({"flags": {"nope": 1}}, {"file_text": "nope = 1"}, {"env": {"LODESTREAM_STEP_S": "x"}}):
        with pytest.raises(ValueError):
            config.settings(**bad)


def test_env_files():
    assert config.parse_env("# a\n\nexport A=1\nB='two words'\nC=\"x=y\"\nD=\n") == {"A": "1", "B": "two words", "C": "x=y", "D": ""}
    with pytest.raises(ValueError, match="line 2"):
        config.parse_env("A=1\nno pair\n")


def test_commands(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"classes": [{"class_id": "a", "label": "A"}]}')
    bad.write_text('{"classes": [{"class_id": "a", "label": "a likely strike"}, {"class_id": "b", "parent": "zz"}]}')
    assert __main__.main(["check-library", str(good)]) == 0 and __main__.main(["check-library", str(bad)]) == 1
    assert "uses likely" in capsys.readouterr().out
    assert __main__.main([]) == 2 and __main__.main(["settings", "step_s=4"]) == 0
    assert "step_s = 4.0 (flag)" in capsys.readouterr().out
