"""The labeller on pages written by hand, none of them from its generator.  The blocks of the article begin with a section sign, which is taken off before."""

import numpy as np

from marlspan.llm import html_extract

A = "§The river rose again on Tuesday, and the town moved its market to the hill."
B = "§Nobody was hurt, but the old bridge will stay closed until engineers have looked at both of its piers."
C = "§We walked along the bank with Maria Lopez, who has kept the records of the flood for forty years. She says that this one was not the worst."
D = "§It ended as it began: with rain."
H = "§When the water came"
LINKS = "<a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a> <a href='/c'>Contact</a>"
LIST = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/w'>Weather</a></li></ul>"
P = "".join(f"<p>{t}</p>" for t in (A, B, C))
DIVS = "".join(f"<div>{t}</div>" for t in (A, B, C, D))

PAGES = {
    "blog theme with divs": f"<nav>{LIST}</nav><div class='td-post'><div>{A}</div><div>{B}</div><div>{C}</div></div><footer>Copyright 2020</footer>",
    "names that say nothing": f"<div id='page'><div class='hd'>{LINKS}</div><div class='c1'><h2>{H}</h2>{P}</div><div class='ft'>All rights reserved</div></div>",
    "comments within the article": f"<header>{LINKS}</header><article><h1>{H}</h1>{P}<section id='comments'><div class='comment'><p>I was there and it was terrible.</p></div><div class='comment'><p>Thank you for this report.</p></div></section></article>",
    "a table that lays out": f"<table><tr><td>{LIST}</td><td><h1>{H}</h1>{P}</td><td class='sidebar'><ul><li><a href='/x'>Most read</a></li></ul></td></tr></table>",
    "no wrapper at all": f"<h1>{H}</h1>{P}",
    "no wrapper, menu before": f"<div>{LINKS}</div><h1>{H}</h1>{P}<p>{D}</p>",
    "wrapper of wrappers": f"<div><div><div class='x9'>{LIST}</div></div><div><div><div class='k2'><h1>{H}</h1>{P}</div></div></div></div>",
    "main and aside": f"<main><h1>{H}</h1>{P}</main><aside><h3>Related</h3><ul><li><a href='/1'>More floods</a></li><li><a href='/2'>Bridges</a></li></ul></aside>",
    "old page": f"<body bgcolor=white><font size=2>{LINKS}</font><h2>{H}</h2>{P}<p>{D}<hr><address>Webmaster</address>",
    "post by entry": f"<div id='wrapper'><div id='header'>{LINKS}</div><div class='entry'><h2>{H}</h2>{P}</div><div id='footer'>Powered by something</div></div>",
    "sections": f"<section><h1>{H}</h1><p>{A}</p></section><section><p>{B}</p><p>{C}</p></section><footer><p>Imprint</p></footer>",
    "cookie notice first": f"<div class='cookie-banner'><p>We use cookies to make this site better.</p></div><article><h1>{H}</h1>{P}</article>",
    "adverts between": f"<article><h1>{H}</h1><p>{A}</p><div class='advert'>Buy a boat today</div><p>{B}</p><p>{C}</p></article>",
    "newsletter form": f"<article><h1>{H}</h1>{P}</article><form class='newsletter'><p>Sign up for our newsletter</p><label>Your address</label></form>",
    "list in the article": f"<div class='story'><h1>{H}</h1><p>{A}</p><ul><li>§The bridge is closed.</li><li>§The market is on the hill.</li></ul><p>{B}</p></div><nav>{LIST}</nav>",
    "quotation": f"<article><p>{A}</p><blockquote>§It was not the worst, I have seen worse in my time.</blockquote><p>{B}</p></article>",
    "divs alone": f"<div>{LIST}</div><div>{DIVS}</div>",
    "head and foot by role": f"<div role='banner'>{LINKS}</div><div role='main'><h1>{H}</h1>{P}</div><div role='contentinfo'>Copyright</div>",
    "crumbs and sharing": f"<div class='breadcrumb'><a href='/'>Home</a><a href='/n'>News</a></div><article><h1>{H}</h1>{P}<div class='share'><a href='/t'>Share</a><a href='/f'>Follow</a></div></article>",
    "wiki": f"<div id='mw-head'>{LIST}</div><div id='bodyContent'><h1>{H}</h1>{P}<h2>§Later floods</h2><p>{D}</p></div><div id='footer'><ul><li>Privacy policy</li></ul></div>",
    "forum first post": f"<div class='menu'>{LIST}</div><div class='post-body'><p>{A}</p><p>{B}</p></div><div class='comments'><p>Good to read.</p><p>So it was.</p></div>",
    "long text": f"<div class='a'>{LINKS}</div><div class='b'>" + P * 12 + "</div>",
}


def test_pages_by_hand():
    names = list(PAGES)
    blocks = [html_extract.blocks_of(f"<html><head><title>t</title></head>{PAGES[n]}</html>") for n in names]
    truth = [np.array([b.text.startswith("§") for b in page]) for page in blocks]
    for page in blocks:
        for b in page:
            b.text = b.text.removeprefix("§")
    found = html_extract.label(blocks, html_extract.trained())
    wrong = {n: [(b.text[:40], bool(f)) for b, f, t in zip(page, good, true) if f != t] for n, page, good, true in zip(names, blocks, found, truth) if (good != true).any()}
    assert all(good.any() for good in found), wrong
    good, true = np.concatenate(found), np.concatenate(truth)
    assert good[true].mean() >= 0.95, wrong
    assert (~good[~true]).mean() >= 0.9, wrong
