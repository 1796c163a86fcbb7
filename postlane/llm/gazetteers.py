"""Word lists of public knowledge that several operators share: short forms of given names, titles, trades, legal forms."""

from __future__ import annotations

import re
import unicodedata

# Given names with their customary short forms. A short form may stand under several names.
SHORT_FORMS = {
    "Aleksandra": "Ola Sandra Alex Sasha", "Alexander": "Alex Sasha Xander Alec Lex", "Alexandra": "Alex Sandra Sasha Lexi", "Andreas": "Andi Andy",
    "Andrew": "Andy Drew", "Anthony": "Tony", "Barbara": "Barb Babs", "Benjamin": "Ben Benny Benji", "Catalina": "Cata Lina", "Catherine": "Cathy Cat Kate Katie",
    "Charles": "Charlie Chuck", "Christian": "Chris", "Christina": "Chris Tina Chrissy", "Christopher": "Chris Kit Topher", "Daniel": "Dan Danny", "Daniela": "Dani",
    "David": "Dave Davy", "Deborah": "Deb Debbie", "Dominika": "Nika", "Dorothea": "Dora Thea Dorle", "Edward": "Ed Eddie Ned Ted", "Eleanor": "Ellie Nell Nora",
    "Elizabeth": "Liz Lizzy Beth Betty Eliza Lisa", "Francisco": "Paco Fran Pancho", "Frederick": "Fred Freddy", "Fredrik": "Fred Freddy", "Gabriela": "Gabi Gaby",
    "Giovanni": "Gio Gianni Nino", "Gregory": "Greg", "Henrietta": "Etta Hettie Hetty", "Ignacio": "Nacho", "Jacqueline": "Jackie", "James": "Jim Jimmy Jamie",
    "Jennifer": "Jen Jenny", "Johannes": "Jo Hannes Hans", "John": "Jack Johnny", "Jonathan": "Jon Johnny", "Joseph": "Joe Joey", "Josephine": "Jo Josie",
    "José": "Pepe", "Jürgen": "Jürg", "Katherine": "Kate Kathy Kat Katie Kitty", "Konstantin": "Kosta Kostja", "Lawrence": "Larry Laurie", "Leonardo": "Leo",
    "Łukasz": "Luki Luke", "Magdalena": "Magda Lena Leni", "Margaret": "Maggie Peggy Meg Greta", "Martina": "Marta Tina", "Matthew": "Matt Matty", "Maximilian": "Max Maxi",
    "Michael": "Mike Mick Mickey Misha", "Nathaniel": "Nat Nate Nathan", "Nicholas": "Nick Nicky Nico", "Nicolas": "Nick Nico", "Ottilie": "Otti Tilly",
    "Patricia": "Pat Patty Trish", "Patrick": "Pat Paddy", "Philippa": "Pippa Pip", "Raphaël": "Rafa Raf", "Rebecca": "Becca Becky", "Renée": "Ren", "Richard": "Rick Dick Rich Ricky",
    "Robert": "Bob Bobby Rob Robbie Bert", "Samantha": "Sam Sammy", "Samuel": "Sam Sammy", "Stephanie": "Steffi Steph", "Stephen": "Steve", "Susanne": "Susi Sanne Suse", "Søren": "Sør",
    "Theodor": "Theo Ted", "Thomas": "Tom Tommy", "Timothy": "Tim Timmy", "Tobias": "Tobi Toby", "Ursula": "Uschi Ulla", "Valentina": "Vale Tina", "Victoria": "Vicky Tori Vic",
    "Wilhelmina": "Mina Willa Minna Helmi", "William": "Bill Will Billy Willy Liam", "Zoë": "Zo",
}
# Further given names that have no short form of their own here.
OTHER_GIVEN = "Carl Carla Erik Erika Jan Jana Julian Juliane Martin Paul Paula Peter Anna Maria Laura Lukas Luis Ana Pedro Pierre Marie Jean Klaus Hans Ingrid Sofia Sophie Emma Tomasz Piotr Ewa".split()
# Titles before names.
TITLES = "dr mr mrs ms miss prof ing dipl herr frau hr fr mme mlle sr sra srta don doña pan pani sig mag mw dhr".split()
# Trades in organisation names with their short and foreign forms.
TRADES = {
    "analytics": "anl analytik analyse", "consulting": "cons consult", "energy": "energie", "foods": "fds food", "furniture": "furn", "insurance": "ins", "logistics": "log logistik",
    "printing": "print prtg", "software": "sw soft", "systems": "sys system", "textiles": "tex textile textil", "travel": "trvl trav", "group": "grp", "media": "", "services": "svc svcs", "solutions": "sol",
}
# Legal forms.
LEGAL_FORMS = ["gmbh", "ag", "inc", "ltd", "llc", "plc", "b.v.", "bv", "n.v.", "nv", "s.a.", "sa", "s.l.", "sl", "sp. z o.o.", "sp z oo", "kg", "co", "corp", "ab", "oy", "a/s", "srl", "s.r.l.", "sarl"]
# Mailboxes that belong to an organisation.
ROLE_MAILBOXES = (
    "info billing no-reply noreply no_reply newsletter news service services orders order notify notification notifications statements support sales contact "
    "hello office team accounts account help helpdesk admin alerts alert mail press jobs hr marketing invoice invoices donotreply do-not-reply mailer updates"
).split()
# Labels before the domain of an organisation that name a mailing system.
MAIL_LABELS = "mail news email mailing info smtp mx mailer newsletter".split()


def fold(s: str) -> str:
    """Lower case without accents; the two ways to write an umlaut come out alike."""
    s = s.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("æ", "a").replace("œ", "o").replace("đ", "d")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"([aou])e", r"\1", s)


def short_form_table() -> dict[str, tuple[str, ...]]:
    """Folded form -> folded full names it may stand for."""
    out: dict[str, set[str]] = {}
    for name, shorts in SHORT_FORMS.items():
        for x in [name, *shorts.split()]:
            out.setdefault(fold(x), set()).add(fold(name))
    for name in OTHER_GIVEN:
        out.setdefault(fold(name), set()).add(fold(name))
    for name in SHORT_FORMS:  # a full name stands for itself only
        out[fold(name)] = {fold(name)}
    return {k: tuple(sorted(v)) for k, v in out.items()}
