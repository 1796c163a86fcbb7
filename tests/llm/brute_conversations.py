"""A plain reading of the definition of the conversations, over lists."""

import json
import re
import unicodedata

NONE = {"", "null", "none", "nil", "undefined", "n/a", "na", "nan", "-", "0", "unknown"}


def tokens(s):
    if not s:
        return []
    try:
        v = json.loads(s)
        v = json.loads(v) if isinstance(v, str) else v
        parts = [str(x) for x in v] if isinstance(v, list) else []
    except ValueError:
        parts = re.split(r"[\s,\[\]\"]+", s)
    return [p for p in (x.strip().strip("<>") for x in parts) if p.lower() not in NONE]


def visible(s):
    return s is not None and any(unicodedata.category(ch)[0] not in "ZC" for ch in s)


def brute(rows):
    """rows: dicts with id, pos, thread_id, in_reply_to, references_json, provider_message_id, sender_email, body_text, utc."""
    mails = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        if r["id"] is not None:
            mails.setdefault(r["id"], r)
    byname = {}
    for i, r in mails.items():
        byname[i] = i
        if r["provider_message_id"]:
            byname[r["provider_message_id"].strip().strip("<>")] = i
    root = {i: i for i in mails}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    bad, answers, threads = set(), {}, {}
    for i, r in mails.items():
        reply = tokens(r["in_reply_to"])
        refs = tokens(r["references_json"])
        for n in reply + refs:
            if n in byname:
                root[find(i)] = find(byname[n])
            else:
                bad.add(i)
        if reply or refs:
            answers[i] = byname.get((reply[:1] or refs[-1:])[0])
        t = (r["thread_id"] or "").strip()
        if t.lower() not in NONE and t.strip("0-"):
            threads.setdefault(t, []).append(i)
    for g in threads.values():
        for x in g[1:]:
            root[find(x)] = find(g[0])
    groups = {}
    for i in mails:
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        if len(g) < 2 or len({(mails[i]["sender_email"] or "").lower() for i in g}) < 2 or any(i in bad for i in g):
            continue
        if any(mails[i]["utc"] is None or not visible(mails[i]["body_text"]) for i in g):
            continue
        if any(answers.get(i) is not None and mails[i]["utc"] < mails[answers[i]]["utc"] for i in g):
            continue
        g.sort(key=lambda i: (mails[i]["utc"], i))
        out += [(g[0], n, i) for n, i in enumerate(g, 1)]
    return out
