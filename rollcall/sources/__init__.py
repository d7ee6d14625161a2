"""rollcall.sources"""
