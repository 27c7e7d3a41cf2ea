"""A log relation made from the driver's ``events``: one expression, valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Q, B = "chr(39)", "chr(92)"
K, N = "cast(event_id % 7 as string)", "cast(1 + event_id % 90 as string)"
TEXT = f"""case event_id % 24
when 0 then '+ %build'
when 1 then concat('+ gcc -c src/f', {K}, '.c')
when 2 then concat('src/f', {K}, '.c:', {N}, ':5: error: use of undeclared identifier ', {Q}, 'v', {K}, {Q})
when 3 then concat('src/f', {K}, '.c:', {N}, ':9: warning: unused variable x [-Wunused-variable]')
when 4 then concat('src/f', {K}, '.c:', {N}, ':2: error: old api [-Werror,-Wdeprecated-declarations]')
when 5 then concat('make[2]: *** [src/f', {K}, '.o] Error 1')
when 6 then concat('/usr/bin/ld: cannot find -lx', {K})
when 7 then concat('main.o: undefined reference to ', {Q}, 's', {K}, {Q})
when 8 then concat('nothing provides pkg', {K}, ' needed by app')
when 9 then concat('Hunk #', {K}, ' FAILED at 3.')
when 10 then 'error: Bad exit status from /var/tmp/rpm-tmp.x (%prep)'
when 11 then concat('File not found: /usr/lib/x', {K})
when 12 then '+ %prep'
when 13 then concat('building object ', {N})
when 14 then concat('+ g++ -o app f', {K}, '.o ', {B})
when 15 then 'app: error: something broke'
when 16 then concat(chr(27), '[31m[ ', {N}, 's] a.S:', {N}, ': fatal error: no')
when 17 then concat('error: unknown warning option ', {Q}, '-Wfoo', {K}, {Q}, ' [-Werror,-Wunknown-warning-option]')
when 18 then 'cc1: all warnings being treated as errors'
when 19 then 'cc1: error: bad [-Werror]'
when 20 then 'spec file has an error: odd'
when 21 then 'Executing(%install): /bin/sh'
when 22 then concat('+ /usr/bin/gcc @objs', {K}, '.rsp -o x')
when 23 then concat('[ 7s] src/f', {K}, '.c:', {N}, ': error: e again') end"""

SQL = f"SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS line_no, {TEXT.replace('as string', 'as varchar')} AS raw_text FROM events"


def logl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own is kept: the rows are few bytes, and the patterns behind them work
    events = events.repartition(n, "user_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("log_id"), F.row_number().over(order).alias("line_no"), F.expr(TEXT).alias("raw_text"))
