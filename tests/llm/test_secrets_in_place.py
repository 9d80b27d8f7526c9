import base64
import gzip

import pytest

from loomgraph.llm import secrets

KEY = "AKIA" + "Z" * 16


@pytest.mark.parametrize(
    "text",
    [
        "password: s3c%2Fret%2Bvalue99",
        '{"password": "s3c%2Fret%2Bvalue99"}',
        "password: s3c\\u002Fret\\u002Bvalue99",
        '{"pass%77ord": "s3c%2Fret%2Bvalue99"}',
        "pass%77ord: s3c\\u002Fret\\u002Bvalue99",
    ],
)
def test_secret_partly_outside_the_run(text):
    at = text.index("s3c") + len("s3c")
    assert any(kind == "assign" and a < at < b for a, kind, b in secrets.scan(text)[1])
    assert "value99" not in secrets.redact("x " + text + " y") and secrets.redact("x " + text + " y").endswith(" y")


def test_latin1_byte_hides_no_key():
    blob = base64.b64encode(b"caf\xe9 " + KEY.encode() + b" end").decode()
    assert (2, "access", 2 + len(blob)) in secrets.scan(f"x {blob} y")[1]


@pytest.mark.parametrize("lead", ["", "data: ", "internationalisation\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_wrapped_base64(lead, packed):
    inner = ("".join(chr(97 + k * k % 23) for k in range(50)) + " " + KEY + " " + "".join(chr(97 + k * 7 % 19) for k in range(150))).encode()
    blob = base64.b64encode(gzip.compress(inner) if packed else inner).decode()
    text = lead + "\n".join(blob[k : k + 76] for k in range(0, len(blob), 76)) + "\n."
    assert any(kind == "access" and a <= len(lead) and b >= len(text) - 2 for a, kind, b in secrets.scan(text)[1])


def test_many_joined_runs_end():
    text = ".".join(base64.b64encode(b"part number %06d" % k).decode().rstrip("=") for k in range(200))
    assert secrets.scan("password: " + text)[1][0][1] == "assign"
