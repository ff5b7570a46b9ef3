"""claimweave.streaming"""
