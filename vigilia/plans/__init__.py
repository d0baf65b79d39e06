"""Named reports. Every function takes a mapping of tables (name -> DataFrame)
and, where time matters, ``as_of``; it returns one lazy DataFrame covering all
keys. ``ordered=False`` drops the presentation sort, which is a full range
shuffle nobody needs when the result is written out or joined further."""
