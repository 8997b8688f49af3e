import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorlog.llm import secret_scan as S


def base(text):
    """The plain patterns, straight from their statement."""
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


parts = st.sampled_from(["password", "PassWd", "api_key", "apiKEY", "token", "ſecret", " ", "  ", "=", ":", '"', "'", "abc123", "deadbeef" * 4,
                         "AKIA" + "Z9" * 9, "AKIA12", "\n", "é", "x", "+", "-_/."])


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_patterns(text):
    spans, secret = S.scan(text)
    assert S.joined([s for s in spans if s[0] != "named"]) == base(text)
    assert all(a[1] <= b[0] for a, b in zip(secret, secret[1:], strict=False))
    assert S.masked(text).count(S.MASK) == len(secret)


def found(text):
    return [text[a:b] for k, a, b in S.scan(text)[0] if k == "named"]


def test_names_and_literals():
    assert found('DB_PASS := "h7Gk29xQ!z"') == ["h7Gk29xQ!z"]
    assert found("  client_credential: q8Zt55pLmW\n") == ["q8Zt55pLmW"]
    assert found("{'privateKey': 'Zx81kQpT44mw'}") == ["Zx81kQpT44mw"]
    assert found('title = "Zx81kQpT44mw"') == []
    assert found("auth_pwd = 'changeme'") == []


def test_constants_flow():
    assert found('part = "Zx81kQpT44mw"\nauth_pwd = part') == ["Zx81kQpT44mw"]
    assert found('a = "Zx81kQpT44"\nb = a\ncred = "pre-" + b') == ["Zx81kQpT44"]
    assert found('a = "Zx81kQpT44mw"\nauth_pwd = "${a}"') == ["Zx81kQpT44mw"]
    assert found('a = "Zx81kQpT44mw"\nb = a') == []


def test_query_columns(docs):
    text = 'x password="abc123" AKIA' + "A" * 16 + " " + "0a" * 12
    row = S.find_secrets(docs([text])).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(base(text).encode()).hexdigest() and row.spans == base(text)
    masked = S.mask_secrets(docs([text])).first()
    assert masked.text == 'x password="[REDACTED]" [REDACTED] [REDACTED]' and masked.n_chars == len(masked.text)


def test_typed_declarations():
    secret = "Zx9-qq!Lm3"
    for text in ('db_password: str = "{}"', 'db_password:str="{}"', "def f(self, auth_pwd: Optional[str] = '{}'):", 'pwd: dict[str, str] | None = "{}"',
                 'const apiToken: string = "{}";', 'const apiToken:string="{}";', 'private apiToken?: string = "{}";', "let userSecret: string | null = '{}'",
                 'var password string = "{}"', 'const apiKey string = "{}"', "const (\n\tpassword string = `{}`\n)", 'var password Phrase = "{}"',
                 'const API_KEY: &\'static str = "{}";', 'val password: String = "{}"', "password : String := '{}';", 'String dbPwd = "{}"',
                 'const std::string dbPwd = "{}"'):
        assert S.masked(text.format(secret)) == text.format(S.MASK), text
    assert found('title: str = "Zx81kQpT44mw"') == found('var title string = "Zx81kQpT44mw"') == []
    assert found('part: str = "Zx81kQpT44mw"\nvar auth_pwd string = part') == ["Zx81kQpT44mw"]
    assert found('pwd: Zx81kQpT44mw = "q8Zt55pLmW"') == ["Zx81kQpT44mw", "q8Zt55pLmW"]
    assert S.scan('apiToken: string = "Zx9-qq!Lm3"')[0][0] == ("assign", 3, 16)  # the plain pattern's own span stays


def test_constants_do_not_double():
    names = [f"{chr(97 + i % 26)}{i}" for i in range(5000)]
    text = f'{names[0]} = "Zx81kQpT44mw"\n' + "".join(f'{y} = {x} + {x} + "q8Zt55pLm{y}"\n' for x, y in zip(names, names[1:]))
    assert found(text) == []
    assert len(found(text + f"auth_pwd = {names[-1]}\n")) == 5000


WHOLE = [
    ('password = "Zx9-qq!Lm3Qk"', 'password = "@"'), ('token: "eyJhb.GciOi~JIUzI1"', 'token: "@"'),
    ('db_pwd = ("Zx9-qq!Lm3Qk")', 'db_pwd = ("@")'), ('db_pwd = """Zx9-qq!Lm3Qk"""', 'db_pwd = """@"""'),
    ("db_pwd = f'Zx9-qq!Lm3Qk'", "db_pwd = f'@'"), ('"db_pwd":\n   "Zx9-qq!Lm3Qk"', '"db_pwd":\n   "@"'),
    ("db_pwd: |\n   Zx9-qq!Lm3Qk\nx: 1", "db_pwd: |\n   @\nx: 1"), ('db_pwd = env or "Zx9-qq!Lm3Qk"', 'db_pwd = env or "@"'),
    ('db_pwd = "Zx9-q" + "q!Lm3" + "Qa7Bc"', 'db_pwd = "@" + "@" + "@"'), ("passphrase = a.strip()", "passphrase = a.strip()"),
    ("cookie: delicious-chocolate9", "cookie: delicious-chocolate9"), ('x = """unclosed', 'x = """unclosed'),
]


@pytest.mark.parametrize("text, wanted", WHOLE)
def test_whole_literals_are_masked(text, wanted):
    assert S.masked(text) == wanted.replace("@", S.MASK)


def test_many_secrets_in_linear_time():
    text = "\n".join(f'password = "Zx9-qq!Lm{i}Qk"' for i in range(8000))
    began = time.perf_counter()
    spans, secret = S.scan(text)
    assert time.perf_counter() - began < 4 and len(secret) == 8000 and len(spans) == 16_000
