"""Dirty tables derived from the given ones; the same SQL runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_CUSTOMER = """
with b as (
 select 0 copy, c_custkey k, c_name, c_acctbal from customer
 union all select 1, c_custkey, c_name, c_acctbal from customer where c_custkey % 28 = 5
 union all select 2, c_custkey, c_name, c_acctbal from customer where c_custkey % 83 = 7)
select copy*100000000+k row_id,
 case when k%50=0 and k>0 then k-1 else k end customer_id,
 case when copy=2 then lower(n) else n end customer_name, email, phone_number, signup_date,
 age, total_spend, discount_rate,
 'ACTIVE' tenant_status, case when k=1 then 'N' else 'Y' end region_flag,
 cast(null as varchar(1)) notes,
 case when k%5=0 then 'x' end mostly_null, comment,
 case when k%3=0 then null when k%3=1 then '   ' else 'v' end mixed
from (select copy,k,
 case when k%11=0 then null when k%13=0 then '  '||c_name||' '
      when k%23=0 then upper(c_name) else c_name end n,
 case when k%7=0 then null when k%17=0 then 'bad_at_nowhere'
      when k%19=0 then 'User'||cast(k as varchar(20))||'@Example.COM'
      else 'user'||cast(k as varchar(20))||'@example.com' end email,
 case when k%31=0 then 'not-a-phone' when k%37=0 then '000'
      else '+1-555-'||lpad(cast(k%1000 as varchar(20)),3,'0')||'-'
           ||lpad(cast(k%10000 as varchar(20)),4,'0') end phone_number,
 case when k%41=0 then 'invalid_date' when k%43=0 then '2023-13-45'
      else '2023-'||lpad(cast(1+k%12 as varchar(20)),2,'0')||'-'
           ||lpad(cast(1+k%28 as varchar(20)),2,'0') end signup_date,
 case when k%47=0 then -5 else 18+k%60 end age,
 case when k%97=0 then 999999.0 else c_acctbal end total_spend,
 case when k%53=0 then 140.0 when k%59=0 then -5.0 else cast(k%40 as double)/2.0 end discount_rate,
 case when k%29=0 then '.' when k%61=0 then 'aaaaa' when k%67=0 then 'test test test'
      when k%71=0 then 'N/A' when k%73=0 then 'two  spaces here'
      when k=2 then repeat('long ',120)
      else 'Customer note number '||cast(k as varchar(20)) end comment
 from b) x
"""

DIRTY_ORDER = """
select o_orderkey row_id,
 case when k%45=0 and k>0 then k-1 else k end order_id,
 case when k%6=0 then cast(k%120 as varchar(20))||'%' else cast(k%120 as varchar(20)) end
   discount_pct,
 case when k%37=0 then 120.5 when k%41=0 then -0.5 else cast(k%100 as double) end error_rate,
 case when k%53=0 then -1-k%7 else 1+k%50 end quantity,
 case when k%2=0 then '2023-'||m||'-'||d else m||'/'||d||'/2023' end order_date,
 case when k%10=3 then 'soon' else cast(1+k%28 as varchar(20))||' Mar 2023' end delivery_time,
 case when k%89=0 then 'pending' else '2022-'||m||'-'||d||' 10:30:00' end updated_at,
 case when k%4=0 then null else k%3=0 end is_priority,
 case when k%5=0 then 'Yes' when k%5=1 then 'no' end answer,
 case when k%10<6 then 'u'||cast(k as varchar(20))||'@shop.example'
      when k%10<8 then 'call me' else 'x@y' end contact,
 case when k%33=0 then '12' else '('||lpad(cast(k%1000 as varchar(20)),3,'0')||') 555.'
      ||lpad(cast(k%10000 as varchar(20)),4,'0') end mobile,
 o_orderpriority priority, o_totalprice balance
from (select *, o_orderkey k, lpad(cast(1+o_orderkey%12 as varchar(20)),2,'0') m,
      lpad(cast(1+o_orderkey%28 as varchar(20)),2,'0') d from orders) x
"""

CUSTOMER_COLUMNS = (
    "customer_id", "customer_name", "email", "phone_number", "signup_date", "age",
    "total_spend", "discount_rate", "tenant_status", "region_flag", "notes", "mostly_null",
    "comment", "mixed",
)
ORDER_COLUMNS = (
    "order_id", "discount_pct", "error_rate", "quantity", "order_date", "delivery_time",
    "updated_at", "is_priority", "answer", "contact", "mobile", "priority", "balance",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(DIRTY_CUSTOMER)


def dirty_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(DIRTY_ORDER)
