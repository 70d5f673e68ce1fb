"""Column types of the stored tables and of landed, decoded feed entities, as DDL."""

from __future__ import annotations

POSITIONS = (
    "id long, trip_id string, route_id string not null, vehicle_id string, vehicle_label string,"
    " latitude double, longitude double, bearing double, current_stop_sequence int,"
    " current_status int, stop_id string, occupancy_status string, timestamp timestamp not null"
)
TRIP_UPDATES = (
    "id long, trip_id string, route_id string not null, stop_id string, stop_sequence int,"
    " arrival_delay int, departure_delay int, arrival_time long, departure_time long,"
    " timestamp timestamp not null"
)
STOP_EVENTS = (
    "trip_id string not null, route_id string not null, stop_id string not null,"
    " stop_sequence int not null, scheduled_time timestamp not null, actual_time timestamp not null,"
    " delay_seconds int not null, service_date date not null, timestamp timestamp not null,"
    " actual_lat double, actual_lon double, actual_bearing double, detection_method string"
)
RIDERSHIP = (
    "route_id string not null, month date not null, boardings int not null,"
    " avg_weekday_boardings int, source string"
)
VEHICLE_ENTITY = (
    "entity_id string, poll_time timestamp, vehicle struct<"
    " trip:struct<trip_id:string,route_id:string>, vehicle:struct<id:string,label:string>,"
    " position:struct<latitude:double,longitude:double,bearing:double>,"
    " current_stop_sequence:int, current_status:int, stop_id:string, occupancy_status:string,"
    " timestamp:long>"
)
UPDATE_ENTITY = (
    "entity_id string, poll_time timestamp, trip_update struct<"
    " trip:struct<trip_id:string,route_id:string>, timestamp:long,"
    " stop_time_update:array<struct<stop_id:string,stop_sequence:int,"
    " arrival:struct<delay:int,time:long>, departure:struct<delay:int,time:long>>>>"
)
SCOREBOARD_POLL = (
    "poll_time timestamp, league string, day_order int, events array<struct<"
    " id:string, date:string, status:struct<type:struct<state:string,shortDetail:string,"
    "detail:string,description:string>>, competitions:array<struct<"
    " id:string, date:string, status:struct<type:struct<state:string,shortDetail:string,"
    "detail:string,description:string>>, venue:struct<fullName:string>,"
    " competitors:array<struct<homeAway:string,score:string,winner:boolean,"
    " team:struct<displayName:string,shortDisplayName:string,name:string,location:string,"
    "nickname:string,abbreviation:string,color:string,alternateColor:string>>>>>>>"
)
