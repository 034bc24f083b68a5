"""Literal spans: every form of assignment with every kind of name and value, and time on hostile texts."""

import itertools
import re
import time

import pytest

from plumbline.llm import secret_scan

SECRET, OTHER = "q7Rz-81kkXw0PbVe52", "Zx81kkq0+Lm3/Pd"
#: {n} is the name, {a} and {b} the halves of the value, {v} the value.
FORMS = [
    '{n} = "{v}"', "{n} = '{v}'", "{n} = `{v}`;", '{n} = "{a}" + "{b}"', '{n} = "{a}" "{b}"', '{n} = ("{a}"\n       "{b}")', 'const {n} = "{a}" +\n  "{b}";',
    '{n}: str = "{v}"', '{n}: Dict[str, List[Tuple[int, Optional[str]]]] = "{v}"', 'x = 1\n{n} := "{v}"\n', '{{"{n}": "{v}"}}', "{{'a': 1, '{n}': '{v}', 'z': 2}}", 'c = {{"{n}": {{"value": "{v}"}}}}',
    'c["{n}"] = "{v}"', 'o.{n} = "{v}"', 'self.{n} = "{v}"', 'connect(user="admin", {n}="{v}", port=1)', '{n} = os.environ.get("NAME_OF_IT", "{v}")', '{n} = decode("{v}")', '{n} = ["{v}"]',
    '{n} = """{v}"""', '{n} = \'\'\'\n{v}\n\'\'\'', '{n}:\n  value: {v}\n', '{n}:\n  - {v}\n  - "{v}"\n', 'top:\n  {n}: {v}\nnext: 1\n', "export {n}={v}\n", "{n}={v}", '  {n}: "{v}"  # why', 'part = "{v}"\n{n} = part\n',
    'm.part = "{v}"\no.part = "plain words"\n{n} = m.part', 'p = "{a}"; q = "{b}"; {n} = p + q', 'p = "{a}"\np += "{b}"\n{n} = p', 'a = {n} = "{v}"', "it's {n} = '{v}' and it's fine", '<x {n}="{v}"/>', "{n} => '{v}',",
    "{n}: |\n  {v}\nnext: 1\n", "top:\n  {n}: >-  # why\n    {a}\n    {b}\n  z: 1\n", "<{n}>{v}</{n}>", '<a:{n} id="1">\n  {v}\n</a:{n}>', 'x = os.environ.get("{n}", "{v}")', "\n" * 50 + '{n} = "{a}"' + "\n" * 50 + '+ "{b}"',
]
NAMES = {"db_credential": True, "passphrase": True, "x" * 400 + "_passphrase": True, "title": False, "credential_path": False}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    for (name, sensitive), value in itertools.product(NAMES.items(), (SECRET, OTHER, "changeme", "two words")):
        if " " in value and re.search(r"[=:] ?\{v\}|- \{v\}|[|>]", form):
            continue
        a, b = value[: len(value) // 2], value[len(value) // 2 :]
        text = form.format(n=name, v=value, a=a, b=b)
        got = [text[x:y] for x, y in secret_scan.lexed_spans(text)]
        found = sensitive and value in (SECRET, OTHER)
        assert ("".join(dict.fromkeys(got)) == value) if found else not got, (text, got)
        if found:  # every literal that holds the value, and nothing else
            where = {m.start() for part in (value, a, b) for m in re.finditer(re.escape(part), text)}
            assert {x for x, _ in secret_scan.lexed_spans(text)} <= where


@pytest.mark.parametrize(
    "text",
    [
        's = s + "x"\n' * 30_000, "s = s + s\n" * 30_000 + "pwd = s", "{" * 200_000, "a: " * 100_000, 'secret: {"a": ' * 20_000, '"' * 300_000, "a='" * 100_000, "x" * 400_000 + "=", "k:\n" * 50_000, "= " * 100_000,
        ("y" * 50 + '"]=') * 10_000, "a[" * 100_000 + "=", " " * 300_000 + "=", "pwd = " + '"a1B-" + ' * 30_000, "a=b=" * 50_000, "\\" * 200_000 + '="', "'''" * 100_001,
        "part = " + " + ".join(f'"{chr(0x4E00 + i % 20000)}{i}"' for i in range(60_000)), 'password = "a"' + "\n" * 500_000 + '+ "b"', "".join(f'secret += "{chr(0x4E00 + i)}x"\n' for i in range(20_000)),
        'base = "' + "x1" * 50_000 + '"\n' + "".join(f'secret{i % 7} = base + "y"\n' for i in range(10_000)), "a:\n" * 1000 + "password: |\n" + "  line\n" * 100_000, "<a " * 100_000, "<a>x</b>" * 60_000, "authorization: bearer " * 30_000,
    ],
)
def test_time_is_linear(text):
    began = time.process_time()
    secret_scan.all_spans(text)
    assert time.process_time() - began < 5


def test_bearer_headers():
    for text in (f"Authorization: Bearer {SECRET}", f'headers = {{"Authorization": "Bearer {SECRET}"}}', f"curl -H 'authorization: token {SECRET}' x"):
        assert [text[a:b] for a, b in secret_scan.lexed_spans(text)] == [SECRET], text
    assert secret_scan.lexed_spans("Authorization: Bearer of the ring") == []


def test_key_in_a_block():
    key = "-----BEGIN RSA PRIVATE KEY-----\n  MIIEow\n  -----END RSA PRIVATE KEY-----"
    text = f"ssh_private_key: |\n  {key}\nname: x\n"
    got = secret_scan.lexed_spans(text)
    assert [text[a:b] for a, b in got] == [x.strip() for x in key.split("\n")]


def test_memory_is_linear():
    """200,000 different literals joined: bounded memory for each."""
    import tracemalloc

    text = "password = " + " + ".join(f'"{chr(0x4E00 + i % 20000)}"' for i in range(200_000))
    tracemalloc.start()
    secret_scan.all_spans(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
