"""A mail server's answers without a server."""

from satchel.sources.mailbox import Server

MESSAGES = {3: (b"\\Seen", b"Subject: one\r\nFrom: Ann <ann@example.com>\r\n\r\ntext"), 9: (b"", b"Subject: two\r\n\r\nmore")}


#: Requests in the order in which they came, in the process that made them; with a ``log`` option they go to a file too.
REQUESTS = []


class Connection:
    def __init__(self, log=None):
        self.log = log

    def note(self, *what):
        REQUESTS.append(what)
        if self.log:
            with open(self.log, "a") as f:
                print(*what, file=f)

    def login(self, user, password):
        assert (user, password) == ("u", "p")

    def authenticate(self, kind, answer):
        assert (kind, answer(b"")) == ("XOAUTH2", b"user=u\x01auth=Bearer t\x01\x01")

    def list(self):
        return "OK", [b'(\\HasNoChildren) "/" "INBOX"', b'(\\HasNoChildren) "/" "Old"', b'(\\Noselect) "/" "[Mail]"']

    def select(self, folder, readonly):
        assert readonly
        self.note("SELECT", folder)
        self.folder = folder
        return ("OK" if folder in ('"INBOX"', '"Old"') else "NO"), [b"2"]

    def uid(self, command, *arguments):
        self.note(command, *arguments)
        own = MESSAGES if self.folder == '"INBOX"' else {}
        if command == "SEARCH":
            words = arguments[0].split()
            low = int(words[words.index("UID") + 1].split(":")[0]) if "UID" in words else 1
            return "OK", [" ".join(str(u) for u in own if u >= low or u == max(own)).encode()]  # the last one always comes
        found = []
        for uid in map(int, arguments[0].split(",")):
            flags, raw = own[uid]
            # the second message's number and flags come behind its body
            first, last = (b"UID %d FLAGS (%s) " % (uid, flags), b")") if uid == 3 else (b"", b" UID %d FLAGS (%s))" % (uid, flags))
            found += [(b"1 (" + first + b'INTERNALDATE "05-Jan-2026 10:00:00 +0000" BODY[] {9}', raw), last]
        return "OK", found


class Fake(Server):
    def connect(self, options):
        return Connection(options.get("log"))
