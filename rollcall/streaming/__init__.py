"""rollcall.streaming"""
