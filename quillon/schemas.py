"""Explicit schemas of the tables that operators read and write, so that empty inputs have columns too."""

from __future__ import annotations

CORPUS = "id string, domain string, source string, author string, text string"
PARSES = "doc_id string, domain string, source string, author string, sent_idx int, sent_text string, parse_str string"
FEATURES = PARSES + ", feng_algo_1 string, feng_algo_2 string"
LOOKUP = "source string, doc_id string, sent_idx int, sent_text string, author string"
JSONL = "sentence string, parse string, author string"
NODES = "array<struct<pre:int,post:int,depth:int,parent:int,ord:int,label:string,word:string>>"
TOKENS = "array<struct<i:int,text:string,pos:string,head:int,dep:string,is_space:boolean>>"

# The closed vocabularies of the data model.
DOMAINS = ["essay", "reuter", "wp"]
SOURCES = ["human", "gpt", "claude"]
TYPE_1 = ["COMPLEX", "COMPLEX-COMPOUND", "COMPOUND", "OTHER", "SIMPLE"]
TYPE_2 = ["LOOSE", "OTHER", "PERIODIC"]
ERROR = "ERROR"
