"""Column types of images, prompts and task results."""

from __future__ import annotations

#: What Spark's image source gives: rows of BGR(A) bytes.
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
BOX = "struct<x:float,y:float,width:float,height:float,label:string,class_id:int,score:float>"
MASK = "struct<class_ids:array<int>,width:int,height:int,labels:array<string>>"
DEPTH = "struct<values:array<float>,width:int,height:int,min_depth:float,max_depth:float>"
PREDICTIONS = "array<struct<label:string,probability:double>>"
PROMPT = "struct<points:array<struct<x:float,y:float>>,labels:array<float>,previous_mask:array<float>>"
SAM_RESULT = "struct<masks:array<array<float>>,iou:array<float>,width:int,height:int>"
ENCODED = "struct<data:binary,media_type:string>"
SCORED = "struct<raw:array<float>,dims:array<int>>"
