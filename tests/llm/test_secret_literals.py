"""Literals of long expressions and of the mildly sensitive names."""

from plumbline.llm import secret_scan


def lexed(text):
    return [text[a:b] for a, b in secret_scan.lexed_spans(text)]


def test_all_of_a_hundred_literals():
    parts = [f"{i:02d}xQ" for i in range(100)]
    assert lexed("db_credential = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert lexed('db_credential = ""\n' + "".join(f'db_credential = db_credential + "{p}"\n' for p in parts)) == parts
    assert lexed('pwd = "Zx81kkq0"\n' + "pwd = pwd + pwd\n" * 100) == ["Zx81kkq0"]


def test_key_and_session():
    assert lexed('part = "abcDEF123456"; key = part + "zz99-QwErTy"\n') == ["abcDEF123456", "zz99-QwErTy"]
    for name in ("key", "hmac_key", "stripe_key", "session"):
        assert lexed(f'{name} = "q7Rz-81kkXw0PbVe52"') == ["q7Rz-81kkXw0PbVe52"]
        assert lexed(f'{name} = "customer_name"') == []
