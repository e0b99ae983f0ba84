"""Schemas of the relations, and the ordered enumerations whose order is their meaning."""

from __future__ import annotations

# Fixed values.
TIERS = ("blocked", "manual_hotfix", "manual", "core", "domain", "base")
PASSES = ("normalization", "grammar", "fluency", "punctuation")
LEVELS = ("sentence", "phrase", "char")
TRUSTS = ("human", "machine", "seed")
UNRANKED = 999

CONTEXT = "left_regex string, right_regex string, full_regex string, left_literal string, right_literal string"
ENTRY = f"entry_id string, src string, tgt string, level string, tier string, priority int, context struct<{CONTEXT.replace(' string', ':string')}>, score double, status string, source string, trust string, updated_by string, updated_at string"
RULE = "rule_id string, pass_name string, type string, pattern string, replacement string, priority int, enabled boolean, note string"
DECISION = "review_id string, decision string, owner string, reason string, src string, tgt string, level string, tier string, priority int, context string, score double, status string, source string, trust string, entry_id string"
REVIEW = "review_id string, created_at string, status string, kind string, action string, owner string, reason string, evidence string, resolved_at string, resolved_by string, decision string, decision_reason string"
MATCH = "struct<entry_id:string,src:string,tgt:string,level:string,tier:string,start:int,end:int,priority:int,score:double>"
HIT = "struct<rule_id:string,pass_name:string,type:string,pattern:string,replacement:string,hit_count:int>"
