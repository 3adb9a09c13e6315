"""Schemas of landed provider dumps, the daily store and the audit log."""

ACTIVITIES = "id BIGINT, date BIGINT, user_id BIGINT, descriptor STRING, propertyInstances ARRAY<STRUCT<property:STRUCT<translationKey:STRING,baseUnit:STRING>,value:STRING>>"
FIT_POINTS = "user_id BIGINT, point ARRAY<STRUCT<startTimeNanos:STRING,endTimeNanos:STRING,value:ARRAY<STRUCT<intVal:BIGINT>>>>"
DAILY = "user_id BIGINT, date DATE, source STRING, steps BIGINT, distance_meters DOUBLE, duration_s DOUBLE, kcalories DOUBLE, raw_json STRING, inserted_at BIGINT"
AUDIT = (
    "ts STRING, kind STRING, name STRING, tool STRING, client_id STRING, request_id STRING, corr_id STRING, purpose STRING, policy STRING, status STRING,"
    " args STRUCT<user_id:STRING,purpose:STRING,policy:STRING,error:STRUCT<code:STRING>,args:STRUCT<user_id:STRING,purpose:STRING,email:STRING,token:STRING>>,"
    " ok BOOLEAN, ms BIGINT, subject_hash STRING"
)
_RULE = "STRUCT<allow:BOOLEAN,redact:ARRAY<STRING>>"
POLICY = f"defaults MAP<STRING,{_RULE}>, clients MAP<STRING,MAP<STRING,{_RULE}>>, tools MAP<STRING,MAP<STRING,{_RULE}>>"
_CONNECTORS = "ARRAY<STRUCT<connected_application:STRING,player_id:STRING,auth_bearer:STRING>>"
REGISTRY = f"users ARRAY<STRUCT<user_id:BIGINT,connected_apps_walk_data:{_CONNECTORS},connected_apps_diabetes_data:{_CONNECTORS},connected_apps_nutrition_data:{_CONNECTORS}>>"
_SCORES = "STRUCT<trivia:DOUBLE,game:DOUBLE,final:DOUBLE>"
ASSESSMENTS = f"users MAP<STRING,STRUCT<entries:ARRAY<STRUCT<date:STRING,final_scores:{_SCORES}>>>>"
PLAYTHROUGH = "STRUCT<Turns:ARRAY<STRUCT<DestinationPathType:INT>>>"
GAMEPLAY = (
    "STRUCT<Aborted:BOOLEAN,Turns:ARRAY<STRUCT<Score:DOUBLE,IsHospitalised:BOOLEAN,GlucoseValueStart:DOUBLE,GlucoseValueEnd:DOUBLE,"
    "MinutesStart:DOUBLE,MinutesEnd:DOUBLE>>>"
)
ENGAGEMENT = "STRUCT<GameplayData:ARRAY<STRUCT<Values:ARRAY<STRING>>>>"
