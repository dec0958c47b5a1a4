"""Schemas of the files that the library reads."""

from __future__ import annotations

_EVENT = "array<struct<NUMBEROFPLAY:int,PLAYTYPE:string,CODETEAM:string,PLAYER_ID:string,MARKERTIME:string,POINTS_A:int,POINTS_B:int,PLAYINFO:string>>"
PERIOD_ARRAYS = ["FirstQuarter", "SecondQuarter", "ThirdQuarter", "ForthQuarter", "ExtraTime"]
FEED = "CodeTeamA string, CodeTeamB string, " + ", ".join(f"{p} {_EVENT}" for p in PERIOD_ARRAYS)
BOXSCORE = "Stats array<struct<Team:string,Coach:string,PlayersStats:array<struct<Player_ID:string,IsStarter:int>>>>"
SHOT_POINTS = "Rows array<struct<NUM_ANOT:int,COORD_X:double,COORD_Y:double,ZONE:string,POINTS:int,FASTBREAK:string,SECOND_CHANCE:string,POINTS_OFF_TURNOVER:string>>"
VIDEOS = "games array<struct<season_code:string,game_code:string,youtube_id:string,youtube_url:string,ocr_profile:string,start_hint_seconds:int,timeline_file:string,enabled:boolean,playback_lead_seconds:double>>"
TIMELINE = "video_time_sec double, quarter string, game_clock string"
# What annotation_status says of a row.
ANNOTATED, EXCLUDED = ["annotated", "complete", "completed"], ["exclude", "excluded"]
GROUND_TRUTH = "season_code string, game_code string, original_event_id int, action_category string, annotation_status string, ground_truth_video_seconds double"
TRIPLE = r"^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|\"((?:[^\"\\]|\\.)*)\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<([^>]*)>)?)\s*\.\s*$"
