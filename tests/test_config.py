"""Settings: where they come from, what is refused, and what they do."""

import json

import pytest

from docloom.sources import config


def test_first_file_over_defaults(tmp_path):
    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / ".docloom").mkdir()
    (tmp_path / ".docloom/config.json").write_text('{"max_candidates": 3, "unknown": 1}')
    assert config.load(str(tmp_path)) == config.Config(max_candidates=3)
    made = config.init(str(tmp_path))
    assert config.load(str(tmp_path)) == config.Config() and json.loads(open(made).read())["max_steps"] == 12
    with pytest.raises(FileExistsError):
        config.init(str(tmp_path))


@pytest.mark.parametrize("text", ["{", "[]", "3", '{"max_candidates": 0}', '{"max_candidates": true}', '{"max_candidates": "5"}', '{"backend": "other"}', '{"surface": "x"}', '{"mock": 1}', '{"jargon": [1]}'])
def test_bad_settings_name_their_file(tmp_path, text):
    (tmp_path / "docloom.json").write_text(text)
    (tmp_path / ".docloom").mkdir()
    (tmp_path / ".docloom/config.json").write_text("{}")
    with pytest.raises(config.BadConfig, match=r"^docloom\.json can't be used"):
        config.load(str(tmp_path))


def test_tokens():
    assert [config.completion_tokens(x, 7) for x in (None, "", "  ", "12", " 5 ")] == [7, 7, 7, 12, 5]
    for x in ("0", "-1", "1.5", "x", "1e3", "٣"):
        with pytest.raises(ValueError):
            config.completion_tokens(x, 7)


def test_candidates_of_a_project(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"C{i}.java").write_text(f'@RestController class C{i} {{\n  @GetMapping("/x") String go() {{ int a = 1; return "" + a; }}\n}}')
    (tmp_path / "docloom.json").write_text('{"max_candidates": 3}')
    assert config.found(spark, str(tmp_path)).count() == 3 and config.found(spark, str(tmp_path), everything=True).count() == 6
