"""Made-up findings with a known truth, set into passages of text."""

from __future__ import annotations

import base64
import random
import string
from dataclasses import dataclass

# What credentials are called, what harmless values are called, and other words.
NAMES = "token secret password passwd pwd api_key apikey access_key access_token auth_token client_secret private_key credential signature secret_key passphrase".split()
OWNERS = ["", "", "", "db", "aws", "app", "user", "admin", "github", "stripe", "smtp", "service", "prod", "my"]
HARMLESS = "commit revision sha1 sha256 md5 checksum digest hash uuid guid order phone card isbn".split()
OTHERS = "id page ref item session build file image object name node key_id version etag request trace user host port".split()
WORDS = "river copper lantern meadow harbor violet thunder basket winter marble orchid falcon cedar pepper silver garden monkey dragon hunter summer".split()
SOURCES = ["", "web", "books", "a/b/test_x.py", "docs/example.md", "config/app.env", "src/main.java", "settings.yml", "forum"]


@dataclass(frozen=True)
class Planted:
    """A text, the byte range of the value in it, the text's path, and whether the value is a secret."""

    text: str
    start: int
    end: int
    source: str
    secret: bool


class _Maker:
    def __init__(self, seed: int, plain: bool):
        self.rng, self.plain = random.Random(seed), plain

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choices(alphabet, k=n))

    def hexa(self) -> str:
        return self.chars("0123456789abcdef", self.rng.choice([32, 40, 64, self.rng.randint(20, 48)]))

    def base(self) -> str:
        out = base64.b64encode(self.rng.randbytes(self.rng.randint(15, 48))).decode()
        return out if self.rng.random() < 0.4 else out.rstrip("=")

    def mixed(self) -> str:
        return self.chars(string.ascii_letters + string.digits + self.rng.choice(["", "", "_-", "+/"]), self.rng.choice([self.rng.randint(18, 48), self.rng.randint(48, 1500)]))

    def uuid(self) -> str:
        h = self.chars("0123456789abcdef", 32)
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    def known(self) -> str:
        letters = string.ascii_letters + string.digits
        r = self.rng
        return r.choice([
            lambda: r.choice(["AKIA", "ASIA"]) + self.chars(string.ascii_uppercase + string.digits, 16), lambda: f"gh{r.choice('pousr')}_" + self.chars(letters, r.choice([30, 36])),
            lambda: f"xox{r.choice('baprs')}-{self.chars(string.digits, 12)}-{self.chars(letters, 24)}", lambda: f"sk{r.choice('-_')}{self.chars(letters, r.randint(24, 48))}",
            lambda: "AIza" + self.chars(letters + "_-", 35), lambda: "github_pat_" + self.chars(letters, 40),
        ])()

    def signed(self) -> str:
        part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
        return ".".join((part(b'{"alg":"HS256"}'), part(b'{"sub":"' + str(self.rng.randrange(10**9)).encode() + b'"}'), part(self.rng.randbytes(self.rng.choice([20, 32])))))

    def pem(self) -> str:
        kind = self.rng.choice(["RSA ", "", "EC ", "OPENSSH "])
        lines = "\n".join(base64.b64encode(self.rng.randbytes(48)).decode() for _ in range(self.rng.randint(1, 12)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"

    def password(self) -> str:
        r = self.rng
        word = r.choice(WORDS)
        if self.plain and r.random() < 0.4:
            return word + r.choice(WORDS)
        word = r.choice([word, word.capitalize(), word.replace("e", "3").replace("o", "0"), word.upper()])
        return r.choice([
            f"{word}{r.choice(['', '!', '#', '$', '@', '*'])}{r.randint(1, 9999)}", f"{word}{r.randint(1, 99)}{r.choice('!#@$%*')}", f"{word}.{r.choice(WORDS)}#{r.choice(WORDS)}{r.randint(0, 9)}",
            self.chars(string.ascii_letters + string.digits + "!#@$%*", r.randint(6, 15)), self.chars("ab", 1) + "@" + self.chars(string.ascii_lowercase, 1) + "#" + self.chars(string.ascii_lowercase, r.randint(2, 6)),
        ])

    def named(self) -> str:
        words = [w for w in (self.rng.choice(OWNERS), *self.rng.choice(NAMES).split("_")) if w]
        return self.rng.choice(["_".join(words), "_".join(words).upper(), words[0] + "".join(w.capitalize() for w in words[1:]), "-".join(words), "_".join(words)])

    def assigned(self, name: str, value: str) -> tuple[str, str]:
        """What stands before and behind a value that is given to a name."""
        r = self.rng
        quote = r.choice(["", "", '"', "'", "`"])
        if r.random() < 0.15:
            return f'{{"{name}": "', '"}'
        if r.random() < 0.12 and not set(value) & set("&?#"):
            host = f"https://{r.choice(WORDS)}.{r.choice(['com', 'org', 'io'])}"
            return f"{host}/v{r.randint(1, 3)}?{r.choice(OTHERS)}={r.randint(1, 99)}&{name}=", r.choice(["", "&page=2", " now"])
        return f"{r.choice(['', '', 'export ', 'config ', 'run with ', 'the '])}{name}{r.choice(['=', '=', ' = ', ': ', ':', ' => ', ' := '])}{quote}", quote + r.choice(["", "", "\n", " end", ";", ",", " # set here"])

    def aside(self, text: str) -> str:
        """Now and then something of another kind right before, which says nothing about the value."""
        r = self.rng
        if r.random() > 0.2:
            return text
        return text.rstrip() + " " + r.choice([
            f"{r.choice(WORDS)}{r.randint(1, 99)}@mail.{r.choice(['example', 'test', r.choice(WORDS)])}.com", f"order {self.chars(string.digits, 12)}", f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}",
            f"commit {self.chars('0123456789abcdef', 7)}", f"the {r.choice(NAMES)}", "for example", f"{r.choice(HARMLESS)} and {r.choice(NAMES)}.",
        ])

    def secret(self) -> tuple[str, str, str]:
        r = self.rng
        k = r.random()
        if k < 0.22:
            return r.choice(["", "see ", "we use ", "id ", "seen ", "key: ", "(", "export KEY="]), r.choice([self.known, self.known, self.signed])(), r.choice(["", " here", ")", "\n", " once"])
        if k < 0.30:
            return r.choice(["key: ", "", "\n", "KEY = "]), self.pem(), "\n"
        if k < 0.38:
            return r.choice(["Authorization: Bearer ", "authorization: bearer ", "-H 'Authorization: Bearer ", "Authorization: Basic "]), r.choice([self.hexa, self.base, self.mixed])(), r.choice(["", "'", "\n"])
        value = r.choice([self.hexa, self.base, self.mixed, self.password, self.password, self.known])()
        before, behind = self.assigned(self.named(), value)
        return before, value, behind

    def harmless(self) -> tuple[str, str, str]:
        r = self.rng
        k = r.random()
        number = lambda: self.chars(string.digits, r.randint(16, 20))
        if k < 0.25:
            return f"{r.choice(HARMLESS)}{r.choice([' ', ' ', ': ', '=', ' = '])}", r.choice([self.hexa, self.hexa, self.uuid, number])(), r.choice(["", " merged", " shipped", "\n", ", "])
        if k < 0.5:
            return r.choice(["", "see ", "in ", "at ", "of ", "path", "(", "file "]), r.choice([self.hexa, self.base, self.mixed, self.uuid, number])(), r.choice(["", " there", ")", " on", ".png", "\n"])
        if k < 0.58:
            return f"https://{r.choice(WORDS)}.com/{r.choice(OTHERS)}/", r.choice([self.hexa, self.mixed, self.uuid])(), r.choice(["", ".jpg", "/view", " "])
        if self.plain and k < 0.65:
            return r.choice(["", "see ", "the "]), r.choice(["", "-", "_", "/"]).join(r.choices(WORDS, k=4)), r.choice(["", " is", "."])
        if k < 0.72:
            joined = r.choice("_-/").join([*r.choices(WORDS + OTHERS, k=r.randint(2, 5)), r.choice(["v", ""]) + str(r.randint(1, 2030))])
            return r.choice(["", "see ", "def ", "in ", "token of ", "the key ", "password for "]), joined.ljust(16, "0"), r.choice(["", " is", ".py", "()"])
        if k < 0.80:
            value = r.choice([self.hexa, self.base])()
            before, behind = self.assigned(f"{self.named()}_{r.choice(['hash', 'sha256', 'md5', 'digest', 'checksum'])}", value)
            return before, value, behind
        if k < 0.92:
            value = r.choice([self.hexa, self.mixed, self.uuid, number])()
            before, behind = self.assigned(r.choice(OTHERS), value)
            return before if k < 0.87 else f"token={r.choice(['x', 'y', '0'])}&{r.choice(['order', 'phone', 'card', 'page'])}=", value, behind
        if k < 0.96:
            return f"{r.choice(['the', 'your', 'a'])} {r.choice(['password', 'token', 'secret'])}: ", r.choice(["please", "remember", "whoever", "nothing", "something"]), r.choice([" now", " it", " of"])
        return f"{r.choice(['', 'the '])}{r.choice(['pwd', 'token', 'key'])}{r.choice([': ', '='])}", self.chars(string.digits, r.randint(6, 18)), r.choice(["", " ", "\n"])


def plant(passages: list[str], n: int, seed: int = 11, plain: bool = False) -> list[Planted]:
    """``n`` findings, every second one a secret, each between two parts of a passage; the same for the same passages.

    With ``plain`` some are words without a digit or sign.
    """
    make, out = _Maker(seed, plain), []
    for i in range(n):
        before, value, behind = make.secret() if i % 2 == 0 else make.harmless()
        passage = passages[i % len(passages)] if passages else ""
        cut = make.rng.randint(0, len(passage))
        left, right = passage[:cut], passage[cut:]
        left = make.aside(left)
        left += make.rng.choice(["", "\n", " "]) if not left or left[-1:].isspace() else make.rng.choice(["\n", " "])
        right = ("" if behind[-1:].isspace() or not right else make.rng.choice(["\n", " "])) + right
        head = (left + before).encode()
        out.append(Planted(left + before + value + behind + right, len(head), len(head) + len(value.encode()), make.rng.choice(SOURCES), i % 2 == 0))
    return out
