"""Declared schemas. Dates and amounts are strings: payment terms and impossible dates share these fields."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "l": T.LongType()}
    fields = [x.split(":") for x in spec.split()]
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields])


RAW_DOCUMENT = _struct("doc_id:s file_name:s label:s source_dataset:s file_type:s extraction_method:s raw_text:s")
CLEAN_DOCUMENT = T.StructType([*RAW_DOCUMENT.fields, *_struct("clean_text:s text_length:i word_count:i").fields])
MANIFEST = _struct("split:s label_id:i class_name:s file_name:s local_path:s original_path:s")
FIELDS = _struct("invoice_number:s invoice_date:s due_date:s issuer_name:s recipient_name:s total_amount:s")
BASELINE = T.StructType([*FIELDS.fields, *_struct("payment_terms:s document_confidence:s invoice_like_score:i ocr_quality_score:d").fields])
TEMPLATE = T.StructType([*BASELINE.fields, *_struct("template_name:s template_score:i").fields])
LAYOUT = T.StructType([*BASELINE.fields, *_struct("layout_confidence:s").fields])
WORD_BOX = _struct("text:s left:i top:i width:i height:i conf:d block_num:i par_num:i line_num:i word_num:i")
OCR_LINE = _struct("text:s left:i top:i right:i bottom:i width:i height:i conf:d block_num:i par_num:i line_num:i")
CANDIDATE_LABEL = _struct("doc_id:s field:s candidate_text:s label:i notes:s")
GOLD = _struct("doc_id:s file_name:s _split:s recipient_name:s invoice_number:s total_amount:s")
DETAIL = _struct("method:s doc_id:s field:s gold:s predicted:s correct:i")
SUMMARY = _struct("method:s field:s gold_docs:l correct:l accuracy:d predicted:l missed:l")
BOX = _struct("l:d t:d r:d b:d")
CLASSIFICATION = T.StructType(
    [T.StructField("predicted_class", T.StringType()), T.StructField("confidence", T.MapType(T.StringType(), T.DoubleType())), T.StructField("method", T.StringType())]
)
SIGNALS = T.StructType(
    [T.StructField("score", T.IntegerType()), T.StructField("matches", T.ArrayType(_struct("signal:s count:i weight:i"))), T.StructField("strong_anchor_count", T.IntegerType()), T.StructField("should_override", T.BooleanType())]
)
_ANNOTATED = T.StructType([T.StructField("text", T.StringType()), T.StructField("bbox", T.ArrayType(T.ArrayType(T.DoubleType())))])
ANNOTATION = T.StructType([T.StructField(n, _ANNOTATED) for n in ("DATE", "DUE_DATE", "TOTAL", "BUYER", "INVOICE_INFO")])
