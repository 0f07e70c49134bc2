"""Response envelopes and errors as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import Coder

RESPONSE = "struct<code:bigint,message:string,request_id:bigint,success:boolean,payload:binary>"
NOT_ENCODED = "the result could not be encoded"
BUSY = "the system is busy, try again later"


def _response(code, message: Column, request_id, success: Column, payload: Column) -> Column:
    cells = (F.lit(code).alias("code"), message.alias("message"), F.lit(request_id).alias("request_id"), success.alias("success"), payload.alias("payload"))
    return F.struct(*cells).cast(RESPONSE)


def success(data: Column, coder: Coder, code: int | Column = 0, request_id: int | Column = 0) -> Column:
    """The encoded data in an envelope; data that give no bytes make it a failure."""
    payload = coder.encode(data)
    ok = payload.isNotNull()
    return _response(code, F.when(ok, "").otherwise(NOT_ENCODED), request_id, ok, payload)


def failure(message: str | Column, code: int | Column, request_id: int | Column = 0, of_system: bool | Column = False) -> Column:
    """An envelope without payload. What went wrong inside the system is not told."""
    text = F.when(F.lit(of_system), BUSY).otherwise(F.lit(message))
    return _response(code, text, request_id, F.lit(False), F.lit(None).cast("binary"))


def error(message: str | Column) -> Column:
    return F.struct(F.lit(message).alias("message"))


def payload_of(response: Column, coder: Coder) -> Column:
    """struct(error, data) of struct(err, payload): the error, or else the decoded payload."""
    failed = response["err"].isNotNull()
    return F.struct(response["err"].alias("error"), F.when(~failed, coder.decode(response["payload"])).alias("data"))
