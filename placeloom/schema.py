"""Tables of each stage as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


RAW_POI = "id string, name string, adname string, address string, location string, type string, business struct<rating:string,opentime_today:string,keytag:string>, photos array<struct<title:string,url:string>>, _city string, _interest_group string, _source_keyword string, _crawled_at string"
CLEAN_POI = "id string, name string, city string, district string, address string, location string, type string, rating double, opentime string, poi_level string, photos array<string>, source string, crawled_at string"
TAGGED_POI = CLEAN_POI + ", is_attraction boolean, tags string, behaviors string, description string"
RAW_ANCHOR = "name string, location string, type string"
CLEAN_ANCHOR = "name string, lat double, lng double, type string"
EVAL_CASE = "id string, query string, profile struct<style:string,interests:array<string>,companion:string,days:int,stay_district:string>, type string, difficulty string, expected_names array<string>, must_not_include array<string>"
PLAN_REQUEST = "request_id long, city string, interests array<string>, companion string, days int, stay_district string, style string, seed long"
NO_RATING, NO_COORDINATE = -1.0, -999.0
