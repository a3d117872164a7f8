from __future__ import annotations

import json

import pytest

from fieldtally.__main__ import main
from fieldtally.config import Config, ConfigError, parse
from test_receiver import land, message


def test_defaults_and_values():
    assert parse("") == Config()
    assert parse('[retention]\npolicy = "halt_and_alarm"\nmax_rows = 5').retention.max_rows == 5


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("[retentoin]", "did you mean 'retention'"), ("[retention]\nmax_row = 1", "did you mean 'max_rows'"), ("[retention]\nmax_rows = 0", "too small"),
        ('[retention]\nmax_rows = "5"', "type int"), ("[retention]\nmax_rows = true", "type int"), ('[shipping]\nsink = "x"', "one of"), ("[shipping]\nmax_backoff_s = 1\ninitial_backoff_s = 2.0", "under initial"), ("x", "config:"), ("input = 3", "section"),
    ],
)
def test_errors_name_the_fix(text, says):
    with pytest.raises(ConfigError, match=says):
        parse(text)


def test_commands(spark, tmp_path, capsys):
    land(spark, str(tmp_path / "in"), "a", [message(1, 5, 5, 0), message(2, 10, 1010, 2), "bad"])
    config = tmp_path / "c.toml"
    config.write_text(f'[input]\npath = "{tmp_path}/in/*"\n[storage]\npath = "{tmp_path}/store"\ncheckpoint = "{tmp_path}/cp"\n')
    assert main(["check", str(config)]) == 0
    assert main(["receive", str(config), "--json"]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found == {"readings": 2, "unsynced": 0, "corrected": 1, "buffers": 1, "gaps": 0, "discarded": 0, "dead_letters": 1}
    config.write_text("")
    assert main(["check", str(config)]) == 2
