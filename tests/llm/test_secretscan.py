import hashlib
import random
import re
import time

import pytest
from evigraph.llm import secretscan as S

VALUE = "q7Rk2mZx81bN"


def plain(text):
    """The base spans by the contract's own patterns."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.BASE.index(s[0])))


def digest(text):
    spans = plain(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*[sum(s[0] == k for s in spans) for k in S.BASE], hashlib.sha256(joined.encode()).hexdigest())


def rows_of(frame):
    return sorted((tuple(r) for r in S.digest(S.find(frame)).collect()), key=repr)


def test_base_spans_of_whole_tables(spark, sample, edge, odd, empty):
    for docs in (sample, edge, odd, empty):
        expected = sorted(((r.doc_id, *digest(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
        assert [r[:5] for r in rows_of(docs)] == expected


def test_base_spans_of_random_texts():
    draw = random.Random(3)
    parts = ["password", "PassWd", "seſret", "secret", "toKen", "Token", "api_key", "APIKEY", "AKIA", "AKIA" + "B" * 12, "abcdef0123456789" * 2, "f" * 31, "é", "\U0001f600",
             *" =:\"'._-+/\n\tAZ09af", "=token=", "12345678"]
    for _ in range(6000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 25)))
        found = S.scan_text(text)
        assert [s[:3] for s in found if s[0] != "literal"] == plain(text)
        assert [s[:2] for s in found] == sorted((s[:2] for s in found), key=lambda s: (s[1], S.KINDS.index(s[0])))
        assert all(text[a:b] == value for _, a, b, _, _, value in found)


FOUND = [
    ("conf['db_pwd'] = 'VALUE'", "db_pwd"), ('const A = "VALUE";\nlet b = A;\nclient.privateKey = b;', "client.privateKey"), ('A = "VALUE"\nB = A + "tail"\nauth_key = B', "auth_key"),
    ("<accessKey> VALUE </accessKey>", "accessKey"), ('set_credential("VALUE")', "set_credential"), ('pwd: str | None = "VALUE"', "pwd"), ("export DB_PWD=VALUE", "DB_PWD"),
    ('"dbPwd" => "VALUE",', "dbPwd"), ("pwd = r'VALUE'", "pwd"), ("spring.datasource.pwd=VALUE", "spring.datasource.pwd"), ("--auth-key=VALUE", "auth-key"), ("don't know; pwd := `VALUE`", "pwd"),
    ('{"user": {"pwd" : "VALUE", "n": 1}}', "pwd"), ('pwd = """VALUE"""', "pwd"), ("a = 'VALUE'\nx.a = 1\nnothing\npwd=a", None),
]


@pytest.mark.parametrize(("text", "name"), FOUND)
def test_literals_that_reach_a_sensitive_name(text, name):
    found = [s for s in S.scan_text(text.replace("VALUE", VALUE)) if s[0] == "literal" and s[5] == VALUE]
    assert [s[4] for s in found] == ([name] if name else [])


NOT_FOUND = [
    "pwd = None", "pwd = '${DB_PWD}'", 'pwd = "your_pwd_here_1"', "pwd = os.environ", "pwd_length = 123456789", "the pwd : whatever words", 'title = "q7Rk2mZx81bN"', "pwd ==\n'q7Rk2mZx81bN'", "pwd = 'aaaaaaaaaaaa'",
    'askpass("Type it in here: ")', "keyboard = 'q7Rk2mZx81bN'", 'A = "q7Rk2mZx81bN"\nA = "other"\npwd = "short"', "", None,
]


@pytest.mark.parametrize("text", NOT_FOUND)
def test_literals_that_reach_none(text):
    assert S.scan_text(text) == []


def test_recall_and_precision_on_planted_sources():
    """Secrets and plain constants at random in made-up sources, half of the secrets through a constant."""
    draw = random.Random(9)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    hit = false = planted = 0
    for _ in range(300):
        lines, secrets = [], set()
        for k in range(draw.randint(1, 12)):
            value = "".join(draw.choices(letters, k=draw.randint(12, 40)))
            if draw.random() < 0.5:
                secrets.add(value)
                name = draw.choice(["db_pwd", "dbPwd", "signing_key", "smtp.credentials", "AUTH_KEY"])
                if draw.random() < 0.5:
                    lines += [f"const v{k} = \"{value}\";", f"{name} = v{k};"]
                else:
                    lines.append(draw.choice([f"{name} = '{value}'", f'"{name}": "{value}",', f"{name}={value}", f"{name}: {value}"]))
            else:
                lines.append(draw.choice([f"title_{k} = '{value}'", f'"label{k}": "{value}",', f"monkey{k}={value}"]))
        found = {s[5] for s in S.scan_text("\n".join(lines))}
        planted += len(secrets)
        hit += len(found & secrets)
        false += len(found - secrets)
    assert hit >= 0.95 * planted and false <= 0.05 * planted


def test_long_texts_take_linear_time():
    n = 60_000
    parts = ['\\"' * n + " pwd = 1", "\\`" * n + " pwd=", "pwd " * n, "pwd" + " " * 2 * n, "<pwd>" + "a" + " " * 2 * n + "b", "\\'''" * n + "pwd=", "pwd = a + " * n, "a = a + a; " * n + "pwd = a", "'" * 2 * n + "pwd=", "password" + " " * n + "x"]
    parts.append("a0='q7Rk2mZx81bN'\n" + "\n".join(f"a{k + 1} = a{k} + 'q7Rk2mZx81b{k}'\npwd{k} = a{k}" for k in range(4000)))
    for text in parts:
        began = time.time()
        S.scan_text(text)
        assert time.time() - began < 10, text[:20]
