from __future__ import annotations

import hashlib
import random
import re
import time

from sketchloom.llm import secrets
from sketchloom.llm.queries import op1_secret_scan

from .helpers import SMALL, extra, odd_documents

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def brute(text: str) -> str:
    spans = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(PATTERNS) for m in p.finditer(text) if good(m)]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_spans_match_the_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op1_secret_scan(spark, SMALL).collect():
        expected = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
        assert r.n_assign + r.n_access + r.n_hex == len(list(filter(None, expected.split(","))))


def test_patterns_on_odd_strings():
    for t in ["password: token: abcdefg", "AKIAAKIA" + "A" * 9, "API_KEY='abcdef'", "ſecret=abcdefgh", "toKen=abcdefgh", "f" * 23 + " " + "0" * 24, "apikey = = x", 'secret":"a/b+c='] + ["passwd=secret=abcdef"]:
        assert secrets.join_spans(secrets.base_spans(t)) == brute(t), t


def lexed(text: str) -> list[str]:
    return [text[a:b] for a, b in sorted(secrets.lexed_spans(text))]


def test_lexer_scores_names_and_literals():
    assert lexed('db_pwd := "x9Kq27vbTz"') == ["x9Kq27vbTz"]
    assert lexed("clientCredential: 'Zx81-kkQ0-pLm2'") == ["Zx81-kkQ0-pLm2"]
    assert lexed('"private_key": "MIIEvQIBADANBgkq"') == ["MIIEvQIBADANBgkq"]
    assert lexed('title = "x9Kq27vbTz"') == [] and lexed('db_pwd = "changeme"') == [] and lexed("auth: the usual way it was") == []


def test_constants_are_propagated():
    text = 'BASE = "q8Wn3xTz71"\nALIAS = BASE\nconn(auth_pwd = ALIAS)\nOTHER = "q8Wn3xTz72"'
    assert lexed(text) == ["q8Wn3xTz71"]
    assert lexed('signing_salt = "aB3dE5fG7" + "hJ9kL1mN2"') == ["aB3dE5fG7", "hJ9kL1mN2"]
    assert lexed("pwd = a\na = b\nb = pwd") == []


def test_odd_rows_and_masking(spark):
    docs = odd_documents(spark)
    assert secrets.find_secrets(extra(docs)).count() == docs.count()
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    masked = secrets.mask_secrets(extra(docs))
    assert masked.columns == extra(docs).columns and masked.count() == docs.count()
    assert masked.where("text LIKE '%a1a1a1%'").count() == 0
    assert secrets.mask("a SECRET b", [(2, 0, 8), (4, 2, 6)]) == "a [SECRET] b"


def test_more_syntax():
    """Calls, long strings and blocks; their parts are scored alone and together."""
    assert lexed('db_pwd = decode("x9Kq27vbTz")') == ["x9Kq27vbTz"]
    assert lexed('conf.set("db_pwd", "x9Kq27vbTz")') == ["x9Kq27vbTz"] and lexed('conf.set("title", "x9Kq27vbTz")') == []
    assert lexed('db_pwd = os.environ.get("DB_PWD", "x9Kq27vbTz")') == ["x9Kq27vbTz"]
    assert lexed("signing_key = '''\n  MIIEvQIBADAN\n  Bgkqhki9w0BA\n'''\nx = 1") == ["MIIEvQIBADAN", "Bgkqhki9w0BA"]
    assert lexed("auth_key: `x9Kq27vbTz`") == ["x9Kq27vbTz"]
    assert lexed("private_key: |\n  MIIEvQIBADAN\n\n  Bgkqhki9w0BA\nname: x9Kq27vbTz") == ["MIIEvQIBADAN", "Bgkqhki9w0BA"]
    assert lexed('# db_pwd = "x9Kq27vbTz"  // old') == ["x9Kq27vbTz"]
    assert lexed('"""\nprose about a token\n"""') == [] and lexed("title: |\n  MIIEvQIBADAN") == []
    assert lexed("db_pwd = `never closed x9Kq27vbTz") == []


def slow_constants(text: str) -> set:
    """The same by following every chain anew: direct literals with each name's weight, then whole values as strings."""
    pairs = secrets.lex(text)
    good = set()

    def reach(parts, direct, seen):
        for a, b, quoted in parts:
            name = text[a:b]
            if not quoted and any(n == name for n, _ in pairs) and secrets.IDENTIFIER.fullmatch(name):
                if name not in seen:
                    seen.add(name)
                    for n, p in pairs:
                        if n == name:
                            yield from reach(p, False, seen)
            elif quoted or direct:
                yield a, b

    def whole(i, inside):
        for a, b, quoted in pairs[i][1]:
            name = text[a:b]
            own = [j for j, (n, _) in enumerate(pairs) if n == name]
            if not quoted and own and secrets.IDENTIFIER.fullmatch(name):
                before = [j for j in own if pairs[j][1][0][0] < a]
                j = before[-1] if before else own[0]
                if j not in inside:
                    yield from whole(j, inside | {j})
            elif a < b and (quoted or not secrets.IDENTIFIER.fullmatch(name)):
                yield a, b

    for i, (name, parts) in enumerate(pairs):
        weight = secrets.name_score(name)
        if weight >= secrets.NAME_LEAST:
            good |= {(a, b) for a, b in reach(parts, True, set()) if weight + secrets.literal_score(text[a:b]) >= secrets.SCORE_LEAST}
            held = list(whole(i, {i}))
            if len(held) > 1 and weight + secrets.literal_score("".join(text[a:b] for a, b in held)) >= secrets.SCORE_LEAST:
                good |= set(held)
    return good


def test_constants_against_following_every_chain():
    """Random programs without cycles among their values: names, chains, forward uses, parts that only together make a secret."""
    r = random.Random(3)
    for _ in range(300):
        names = ["db_pwd", "auth_token", "title", "a", "b", "c", "salt", "key"]
        lines = []
        for i in range(r.randint(1, 12)):
            target = r.choice(names)
            later = names[names.index(target) + 1 :]  # so no value needs itself
            values = ["\"".join(["", "".join(r.choice("aB3x<>") for _ in range(r.randint(0, 9))), ""]) for _ in range(2)] + ["'change'", "'me'", "'xxx'", "12345", *later]
            lines.append(f"{target} = " + " + ".join(r.choice(values) for _ in range(r.randint(1, 3))))
        text = "\n".join(lines)
        assert set(secrets.lexed_spans(text)) == slow_constants(text), text


def test_long_texts_take_linear_time():
    """Many uses of one name, long chains and thousands of spans: a text of 5 MB ends in seconds."""
    began = time.time()
    uses = "\n".join("db_pwd = x" for _ in range(20_000)) + "\n" + "\n".join(f'x = "aB3dE5fG{i}"' for i in range(20_000))
    assert len(secrets.scan(uses)[1]) == 20_000
    chain = 'k0 = "aB3dE5fGh"\n' + "\n".join(f'secret_k{i + 1} = secret_k{i} + "q{i}"' for i in range(20_000))
    assert len(secrets.scan(chain)[1]) > 19_000
    dump = "\n".join(f'"db_pwd_{i}": "x9Kq27v{i}",  token = {i:032x}' for i in range(90_000))
    assert len(dump) > 5_000_000 and len(secrets.scan(dump)[1]) >= 180_000
    secrets.scan("name = `" * 100_000), secrets.scan("'" * 500_000), secrets.scan("a: |\n" * 100_000), secrets.scan("f('a'," * 200_000)
    assert time.time() - began < 60
    print("seconds", time.time() - began)
