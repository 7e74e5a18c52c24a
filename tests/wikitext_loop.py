"""Wikitext rules as a plain loop over one text, to hold the column form against."""

import re

_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\]")


def _templates(text):
    for _ in range(10):
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    return text


def _box(raw):
    head = re.match(r"\{\{[Ii]nfobox[^\n]*\n", raw)
    if not head:
        return raw
    fields, key = {}, None
    for line in map(str.strip, _templates(raw[head.end():].rstrip()[:-2]).split("\n")):
        bar, name, value = line[:1] == "|", *[x.strip() for x in line[1:].partition("=")[::2]]
        if bar and "=" in line:
            key = name
            fields.setdefault(key, []).append(value)
        elif not bar and line and key is not None:
            fields[key].append(line)
    shown = {k: " ".join(_LINK.sub(r"\1", " ".join(v)).replace("''" "'", "").replace("''", "").split()) for k, v in fields.items() if k}
    return "\n".join(f"{k} = {v}" for k, v in shown.items() if v)


def plain(text):
    out, at, boxes, text = "", 0, [], text or ""
    while (start := text.lower().find("{{infobox", at)) >= 0:
        depth = 0
        for m in re.finditer(r"\{\{|\}\}", text[start:]):
            depth += 1 if m[0] == "{{" else -1
            if depth == 0:
                break
        if depth:
            break
        out += text[at:start] + f"\n\n﷐{len(boxes)}﷐\n\n"
        at = start + m.end()
        boxes.append(_box(text[start:at]))
    out = _templates(out + text[at:])
    out = re.sub("﷐(\\d+)﷐", lambda m: boxes[int(m[1])], out)
    out = _LINK.sub(r"\1", re.sub(r"<[^>]+>", "", out))
    return re.sub(r"[ \t]+", " ", out.replace("'''", "").replace("''", "")).strip()
