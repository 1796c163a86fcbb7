"""Problem 2: what earlier mails and a sender's other mails tell of a line."""

from postlane.llm import quotes

FIRST = "The delivery of the twelve oak tables was moved to the second week of March because the carrier lost a truck."
ROW = "pos bigint, id string, sender_email string, sender_name string, body_text string, thread_id string, in_reply_to string, references_json string, provider_message_id string"


def _features(spark, rows):
    """Line number to features, by id."""
    emails = spark.createDataFrame(rows, ROW)
    mails = quotes._mails(emails)
    links = quotes.parents(mails).join(mails.selectExpr("id as parent", "pos as ppos"), "parent").join(mails.select("id", "pos"), "id")
    got = quotes.context(emails, mails, links, quotes.frequent_lines(emails, mails)).collect()
    out = {}
    for r in got:
        no, x = quotes.line_features(r.body, r.sender, r.name, r.parent, set(r.frequent or []), r.hashes)
        out[r.id] = dict(zip(no, x))
    return out


def test_text_of_a_grandparent_that_the_parent_quotes(spark):
    reply = "Understood, we will wait then.\n\nOn Mon, 2 Mar 2026 at 10:00, Ann wrote:\n> " + FIRST
    rows = [
        (1, "a", "ann@x.com", "Ann", FIRST, "t", None, None, None),
        (2, "b", "bob@y.com", "Bob", reply, "t", "a", None, None),
        (3, "c", "cid@z.com", "Cid", "Please look at this:\n\n" + FIRST, "t", "b", None, None),
    ]
    got = _features(spark, rows)["c"]
    assert got[3][quotes._AT["overlap"]] == 7
    assert got[1][quotes._AT["overlap"]] == 0


def test_a_long_notice_that_the_sender_repeats(spark):
    notice = "This message is confidential and meant for the addressee only; please delete it if it reached you by mistake."
    rows = [(n, f"m{n}", "ann@x.com", "Ann", f"{text}\n\n{notice}", f"t{n}", None, None, None) for n, text in enumerate(["The tables are ready.", "Shall we meet on Friday?", "Here is the list."])]
    got = _features(spark, rows)["m1"]
    assert (got[3][quotes._AT["frequency"]], got[3][quotes._AT["notice"]]) == (1, 2)
    assert got[1][quotes._AT["frequency"]] == 0


def _lines(*rows):
    import numpy as np

    x = np.zeros((len(rows), quotes.N), dtype=np.uint8)
    for k, row in enumerate(rows):
        for name, v in row.items():
            x[k, quotes.IN_PARENT if name == "parent" else quotes._AT[name]] = v
    return x.tobytes()


def test_labels_come_from_where_else_a_line_stands():
    # hashes: 1 and 2 own lines, 7 stands below them in both mails, 8 once among them, 9 in the parent; no mark is set anywhere
    one = ("ann", [1, 8, 1001, 7], _lines({"words": 7}, {"words": 7, "frequency": 1}, {"words": 7}, {"words": 2, "frequency": 1}))
    two = ("bob", [2, 7, 9], _lines({"words": 7}, {"words": 2, "frequency": 1}, {"words": 7, "parent": 1}))
    x, y = quotes.labelled([one, two])
    half = len(y) // 2
    assert y[:half].tolist() == [0, 0, 0, 1, 0, 1, 1]
    assert x[half:, quotes._AT["frequency"]].sum() == 0 and x[:half, quotes._AT["frequency"]].sum() == 3


def test_the_trees_follow_the_evidence_not_the_marks():
    from postlane.llm import boosting

    # a closing that stands among own lines everywhere is no closing here
    rows = [(f"s{n}", [100 + n, 5, 200 + n], _lines({"words": 7}, {"words": 2, "closing": 1, "frequency": 1}, {"words": 7})) for n in range(30)]
    x, y = quotes.labelled(rows)
    model = boosting.fit(x, y, 10, 3)
    assert boosting.predict(model, x[1:2])[0] < 0.5


def test_nulls_empty_and_repeated_mails(spark):
    body = "We moved the twelve oak tables to the other hall.\n\nBest regards,\nAnn"
    rows = [(n, f"m{n}", "ann@x.com", "Ann", body.replace("twelve", str(n)), None, None, None, None) for n in range(12)]
    rows += [(20, "m0", "ann@x.com", "Ann", body.replace("twelve", "0"), None, None, None, None), (21, "z", None, None, None, None, None, None, None), (22, None, "b@x", "B", body, None, None, None, None), (23, "y", "b@x", "B", " \n\t", None, None, None, None)]
    got = sorted(tuple(r) for r in quotes.found_lines(spark.createDataFrame(rows, ROW)).collect())
    assert got == sorted((f"m{n}", k) for n in range(12) for k in (3, 4))
    assert quotes.found_lines(spark.createDataFrame([], ROW)).count() == 0


def test_costly_expressions_are_tried_only_where_they_can_match(monkeypatch):
    tried = []

    class Watched:
        def __init__(self, name):
            self.name, self.match = name, lambda text: tried.append((self.name, text))

    body = "We moved the oak tables to the other hall.\nNobody asked for them.\n\nOne carrier lost a truck, so we wait.\nIt is late."
    for name in ("_INTRO_START", "_INTRO", "_HEAD", "_SEP", "_CLOSE", "_DEVICE", "_SALUTE", "_WARNING"):
        monkeypatch.setattr(quotes, name, Watched(name))
    no, x = quotes.line_features(body, "ann@x.com", "Ann", "Where are the oak tables now, and who moved them?", set(), None)
    assert no == [1, 2, 4, 5] and x.shape == (4, quotes.N)
    assert tried == []


def test_what_is_needed_for_a_match_holds_for_every_match():
    closings = [c for line in quotes.CLOSINGS.splitlines() for c in line.split("|")]
    devices = "Sent from my X|sent via X|Get X for Y|Gesendet von X|Von meinem X gesendet|Envoyé de X|Enviado desde X|Wysłane z X|Verstuurd vanaf X|Verzonden met X|Inviato da X|Skickat från X|Enviado do X".split("|")
    warnings = "Ext: x|[EXTERN] x|*** Zewnętrzny: x|externo: x|Esterno: x|Caution: x|! WARNING : x|Achtung: x|Attention: x|Atención: x|Uwaga: x|Let op: x|Attenzione: x|Varning: x|> external mail".split("|")
    greetings = "Hi|Hello A|Hey|Dear A|Good day|Hallo|Liebe A|Guten Tag|Sehr geehrte A|Moin|Bonjour|Bonsoir|Cher A|Chère A|Salut|Hola|Buenas|Estimada A|Querida A|Cześć|Dzień dobry|Witam|Szanowna A|Goedemorgen|Beste A|Geachte A|Ciao|Buongiorno|Gentile A|Olá|Hej|God morgon".split("|")
    for may, expression, lines in ((quotes._MAY_CLOSE, quotes._CLOSE, closings), (quotes._MAY_DEVICE, quotes._DEVICE, devices), (quotes._MAY_WARN, quotes._WARNING, warnings), (quotes._MAY_SALUTE, quotes._SALUTE, greetings)):
        for line in (y for x in lines for y in (x, x.lower(), x.upper(), x.replace("s", "ſ"))):
            assert may[line[:3]] or expression.match(line) is None, line
        assert all(expression.match(x) for x in lines)
    assert all(any(p in w for p in quotes._WROTE_PARTS) for w in quotes._WROTE_WORDS)
    for text in ["".join(map(chr, range(128))), "a_b c-d\x1ce\x85f", "grüße, l'été 2²", ""]:
        assert quotes._words(text) == quotes._WORD.findall(text)
