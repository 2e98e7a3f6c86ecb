"""The queries of this subpackage."""

from __future__ import annotations

from quire.llm import bpe, chat, cotrain, decontaminate, html, jaccard, licenses, oracles, pii, quality, toxicity
from quire.llm.common import table


def op1_chat_format(spark, sf_dir):
    return chat.digest(chat.windows(chat.with_control_strings(table(spark, sf_dir, "conversations"))))


def op2_html_extract(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark, sf_dir):
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_bpe(spark, sf_dir):
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), decoded=True))


def op5_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op6_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark, sf_dir):
    return cotrain.digest(cotrain.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    named = (op1_chat_format, op2_html_extract, op3_quality_rules, op4_bpe, op5_license_scan, op6_jaccard_join, op7_pii, op8_quality_classifier, op9_toxicity, op10_decontaminate)
    return {f.__name__: f for f in named}


def oracle_sql():
    return {"op2_html_extract": oracles.OP2, "op3_quality_rules": oracles.OP3, "op6_jaccard_join": oracles.OP6}
